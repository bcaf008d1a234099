"""PostgreSQL syntax to Spark SQL, token by token; what neither side knows is left for Spark to refuse."""

from __future__ import annotations

import re

from ..functions import pg

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[eE]'(?:[^'\\]|''|\\.)*'|'(?:[^']|'')*')|(?P<dollar>\$\$.*?\$\$)|(?P<name>\"(?:[^\"]|\"\")*\"|[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"|(?P<param>\$\d+)|(?P<op>::|->>|->|\#>>|\#>|@>|<@|<>|!=|<=|>=|\|\||!~\*|~\*|!~|[-+*/%=<>(),.;\[\]:~?])",
    re.S,
)
UNITS = {"year": "YEAR", "years": "YEAR", "mon": "MONTH", "mons": "MONTH", "month": "MONTH", "months": "MONTH", "week": "WEEK", "weeks": "WEEK", "day": "DAY", "days": "DAY"} | {
    u + s: u.upper() for u in ("hour", "minute", "second") for s in ("", "s")
}
TYPES = {
    "text": "STRING", "varchar": "STRING", "character": "STRING", "char": "STRING", "name": "STRING", "uuid": "STRING", "json": "STRING", "jsonb": "STRING", "int2": "SMALLINT", "int4": "INT",
    "integer": "INT", "int": "INT", "int8": "BIGINT", "serial": "INT", "bigserial": "BIGINT", "float4": "FLOAT", "real": "FLOAT", "float8": "DOUBLE", "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "numeric": "DOUBLE", "decimal": "DOUBLE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "bytea": "BINARY", "interval": "STRING", "time": "STRING", "double": "DOUBLE", "smallint": "SMALLINT", "bigint": "BIGINT", "date": "DATE", "float": "DOUBLE", "oid": "BIGINT",
}
RENAMED = {"character_length": "char_length", "jsonb_array_length": "json_array_length", "string_agg": "listagg", "bool_and": "bool_and", "regexp_matches": "regexp_like"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"42601: cannot read {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return out


#: What a letter after a backslash means in E'...'.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def literal(token: str) -> str:
    body = token[token.index("'") + 1 : -1]
    if token[0] in "eE":
        made = lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2], 16)) if m[2] else chr(int(m[3], 8)) if m[3] else ESCAPES.get(m[4], m[4])
        parts = re.split(r"(\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.))", body, flags=re.S)
        return "".join(re.sub(r"\\(?:u(.{4})|x(.+)|([0-7]+)|(.))", made, p, flags=re.S) if p[:1] == "\\" else p.replace("''", "'") for p in parts)
    return body.replace("''", "'")


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matching(t: list[tuple[str, str]], at: int) -> int:
    """The index of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(t)):
        depth += t[i][1] in "([" and t[i][0] == "op"
        depth -= t[i][1] in ")]" and t[i][0] == "op"
        if depth == 0:
            return i
    raise ValueError("42601: a bracket is left open")


def split_top(t: list[tuple[str, str]], by: str = ",") -> list[list[tuple[str, str]]]:
    """Parts between the top-level commas (or another operator)."""
    parts: list[list[tuple[str, str]]] = [[]]
    depth = 0
    for kind, x in t:
        if kind == "op":
            depth += x in "(["
            depth -= x in ")]"
            if x == by and depth == 0:
                parts.append([])
                continue
        parts[-1].append((kind, x))
    return parts if parts != [[]] else []


def word(t: list[tuple[str, str]], at: int) -> str:
    return t[at][1].lower() if 0 <= at < len(t) and t[at][0] == "name" else ""


def render(t: list[tuple[str, str]]) -> str:
    out = ""
    for kind, x in t:
        if kind == "text":
            x = quoted(literal(x))
        elif kind == "name" and x[0] == '"':
            x = "`" + x[1:-1].replace('""', '"').replace("`", "``") + "`"
        out += x if x in (".", "::") or out.endswith((".", "::")) else " " + x
    return out.strip()


def interval(text: str) -> list[str] | None:
    """'1 year 2 mons 3 days 04:05:06' as a sum of single-unit Spark intervals."""
    parts = []
    rest = text.strip()
    for n, unit in re.findall(r"([-+]?\d+)\s*([a-zA-Z]+)", rest):
        if unit.lower() not in UNITS:
            return None
        parts.append(f"INTERVAL '{int(n)}' {UNITS[unit.lower()]}" if UNITS[unit.lower()] != "WEEK" else f"INTERVAL '{7 * int(n)}' DAY")
    if m := re.search(r"(-?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", rest):
        parts.append(f"INTERVAL '{m[1]}{int(m[2])}:{m[3]}:{m[4] or '00'}' HOUR TO SECOND")
    return parts or None


KEYWORDS = frozenset(
    "select from where and or not on in when then else case having by distinct all as is like ilike between union intersect except limit offset order group set values returning with using join"
    " left right full inner cross natural lateral over partition rows range groups filter exists any some if interval end null true false asc desc nulls first last window qualify within similar escape collate at".split()
)
#: Keywords an operand may end with.
ENDS = frozenset(("end", "null", "true", "false"))


def _operand_start(out: list[tuple[str, str]]) -> int:
    """Where the operand that ends ``out`` begins: a name path, literal, call, window call, CASE or bracket, with casts."""
    i = len(out) - 1
    while i >= 0:
        if word(out, i) == "end":
            depth = 0
            while i >= 0:
                depth += (word(out, i) == "end") - (word(out, i) == "case")
                if depth == 0:
                    break
                i -= 1
        if out[i][1] in (")", "]"):
            depth = 0
            while i >= 0:
                depth += out[i][1] in (")", "]")
                depth -= out[i][1] in ("(", "[")
                if depth == 0:
                    break
                i -= 1
            if word(out, i - 1) in ("over", "filter") or (word(out, i - 1) == "group" and word(out, i - 2) == "within"):
                i -= 2 + (word(out, i - 1) == "group")
                continue
            if i > 0 and out[i - 1][0] == "name" and word(out, i - 1) not in KEYWORDS - {"left", "right", "if"}:
                i -= 1
        if word(out, i - 1) == "over":
            i -= 2
            continue
        if i > 1 and out[i - 1][1] in (".", "::"):
            i -= 2
            continue
        return i
    return 0


def _operand_end(t: list[tuple[str, str]], at: int) -> int:
    """One past the operand that begins at ``at``."""
    if t[at][1] in ("-", "+"):
        at += 1
    if word(t, at) == "array" and at + 1 < len(t) and t[at + 1][1] == "[":
        at = matching(t, at + 1) + 1
    elif word(t, at) == "case":
        depth = 0
        while at < len(t):
            depth += (word(t, at) == "case") - (word(t, at) == "end")
            at += 1
            if depth == 0:
                break
    elif word(t, at) in ("date", "timestamp", "interval", "time") and at + 1 < len(t) and t[at + 1][0] == "text":
        at += 2
    elif t[at][1] in "([":
        at = matching(t, at) + 1
    else:
        at += 1
        while at + 1 < len(t) and t[at][1] == ".":
            at += 2
        if at < len(t) and t[at][1] == "(":
            at = matching(t, at) + 1
    while at < len(t):
        if t[at][1] == "[":
            at = matching(t, at) + 1
        elif word(t, at) in ("over", "filter") and at + 1 < len(t):
            at = matching(t, at + 1) + 1 if t[at + 1][1] == "(" else at + 2
        elif t[at][1] == "::" and at + 1 < len(t):
            at += 2 + (word(t, at + 1) == "double")
            if at < len(t) and t[at][1] == "(":
                at = matching(t, at) + 1
        else:
            break
    return at


def _ends_operand(out: list[tuple[str, str]]) -> bool:
    if not out:
        return False
    kind, x = out[-1]
    return kind in ("number", "text", "param", "raw") or x in (")", "]") or (kind == "name" and (x.lower() not in KEYWORDS or x.lower() in ENDS))


WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"


def arithmetic(op: str, left: str, right: str) -> str:
    """Multiplication, division and remainder without errors: null for a zero divisor or an overflow.  Whole numbers divide to whole
    ones; the type of their quotient is DOUBLE unless both are literals."""
    if op == "*":
        return f"try_multiply({left}, {right})"
    if op == "%":
        return f"try_mod({left}, {right})"
    if re.fullmatch(r"-?\d+", left) and re.fullmatch(r"-?\d+", right):
        return f"({left} div nullif({right}, 0))"
    whole = f"try_cast(try_cast({left} AS STRING) AS BIGINT) div nullif(try_cast(try_cast({right} AS STRING) AS BIGINT), 0)"
    return f"CASE WHEN typeof({left}) IN {WHOLE} AND typeof({right}) IN {WHOLE} THEN {whole} ELSE try_divide({left}, {right}) END"


def _type_end(t: list[tuple[str, str]], at: int) -> int:
    """One past the type name that begins at ``at``."""
    at += 1 + (word(t, at) == "double" or (word(t, at) == "character" and word(t, at + 1) == "varying"))
    if at < len(t) and t[at][1] == "(":
        at = matching(t, at) + 1
    if word(t, at) in ("with", "without") and word(t, at + 1) == "time":
        at += 3
    while at < len(t) and t[at][1] == "[":
        at = matching(t, at) + 1
    return at


def _top_as(t: list[tuple[str, str]], start: int, end: int) -> int:
    depth, found = 0, -1
    for i in range(start, end):
        depth += (t[i][1] in ("(", "[")) - (t[i][1] in (")", "]"))
        if depth == 0 and word(t, i) == "as":
            found = i
    return found


def _top_order(t: list[tuple[str, str]], start: int, end: int) -> int:
    depth = 0
    for i in range(start, end):
        depth += (t[i][1] in ("(", "[")) - (t[i][1] in (")", "]"))
        if depth == 0 and word(t, i) == "order" and word(t, i + 1) == "by":
            return i
    return -1


def T(text: str) -> list[tuple[str, str]]:
    return [("raw", text)]


def _trim(name: str, t: list[tuple[str, str]]) -> str:
    """TRIM([LEADING | TRAILING | BOTH] [characters] FROM text), trim(text [, characters]) and its one-sided forms: white space of any kind
    is what goes without characters."""
    call = {"trim": "btrim"}.get(name, name)
    if word(t, 0) in ("leading", "trailing", "both"):
        call = {"leading": "ltrim", "trailing": "rtrim", "both": "btrim"}[word(t, 0)]
        t = t[1:]
    depth, cut = 0, -1
    for i, (kind, x) in enumerate(t):
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if depth == 0 and word(t, i) == "from":
            cut = i
    if cut >= 0:
        text, characters = render_all(t[cut + 1 :]), render_all(t[:cut]) if cut else ""
    else:
        args = split_top(t)
        text, characters = render_all(args[0]), render_all(args[1]) if len(args) > 1 else ""
    side = {"btrim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[call]
    return f"trim({side} {characters or quoted(pg.WHITE)} FROM {text})"


def _system_function(name: str, args: list[str]) -> str:
    """The pg_* functions that introspection calls, as constants or lookups."""
    of = {str(number): label for label, (number, _) in PG_TYPES.items()}
    cases = " ".join(f"WHEN {n} THEN '{label}'" for n, label in of.items())
    return {
        "format_type": lambda: f"CASE {args[0]} {cases} ELSE '???' END",
        "current_schemas": lambda: "array('pg_catalog', 'public')",
        "pg_get_userbyid": lambda: "'postgres'",
        "pg_table_is_visible": lambda: f"({args[0]} IS NOT NULL)",
        "has_table_privilege": lambda: "TRUE",
        "has_schema_privilege": lambda: "TRUE",
        "pg_encoding_to_char": lambda: "'UTF8'",
        "pg_backend_pid": lambda: "1",
        "pg_get_expr": lambda: args[0],
    }.get(name, lambda: "CAST(NULL AS STRING)")()


#: PostgreSQL's numbers and lengths of its basic types, fixed values.
PG_TYPES = {
    "boolean": (16, 1), "bytea": (17, -1), "name": (19, 64), "bigint": (20, 8), "smallint": (21, 2), "integer": (23, 4), "text": (25, -1), "oid": (26, 4), "json": (114, -1), "real": (700, 4),
    "double precision": (701, 8), "character varying": (1043, -1), "date": (1082, 4), "time without time zone": (1083, 8), "timestamp without time zone": (1114, 8),
    "timestamp with time zone": (1184, 8), "interval": (1186, 16), "numeric": (1700, -1), "uuid": (2950, 16), "jsonb": (3802, -1),
}


SERIES = "explode(CASE WHEN ({s}) > 0 AND ({a}) <= ({b}) OR ({s}) < 0 AND ({a}) >= ({b}) THEN sequence({a}, {b}, {s}) ELSE CAST(array() AS ARRAY<BIGINT>) END)"


def table_function(name: str, args: list[str], ordinal: bool) -> tuple[str, int] | None:
    """A generator for a set-returning function, and how many columns it gives before the ordinality."""
    explode = "posexplode" if ordinal else "explode"
    if name == "generate_series":
        step = args[2] if len(args) > 2 else "1"
        return SERIES.format(a=args[0], b=args[1], s=step).replace("explode(", f"{explode}(", 1), 1
    if name == "unnest":
        if len(args) == 1:
            return f"{explode}({args[0]})", 1
        zipped = ", ".join(args)
        return (f"posexplode(arrays_zip({zipped}))" if ordinal else f"inline(arrays_zip({zipped}))"), len(args)
    if name in ("jsonb_array_elements", "json_array_elements", "jsonb_array_elements_text", "json_array_elements_text"):
        return f"{explode}(from_json({args[0]}, 'array<string>'))", 1
    if name == "regexp_split_to_table":
        return f"{explode}(split({args[0]}, {args[1]}))", 1
    return None


def rewrite(text: str) -> str:
    return render_all(tokens(text))


def render_all(t: list[tuple[str, str]]) -> str:
    t = _distinct_on(_groups(_limited(_fetch(t))))
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(t):
        kind, x = t[i]
        low = x.lower() if kind == "name" else ""
        after = t[i + 1][1] if i + 1 < len(t) else ""
        if kind == "param":
            out.append(("raw", f":p{x[1:]}"))
        elif low == "array" and after == "[":
            end = matching(t, i + 1)
            out += T(f"array({render_all(t[i + 2 : end])})")
            i = end
        elif kind == "op" and x in ("*", "/", "%") and _ends_operand(out) and i + 1 < len(t) and t[i + 1][1] not in (")", ",") and word(t, i + 1) not in ("from", "where"):
            start, end = _operand_start(out), _operand_end(t, i + 1)
            left, right = render(out[start:]), render_all(t[i + 1 : end])
            del out[start:]
            out += T(arithmetic(x, left, right))
            i = end - 1
        elif x == "::" and i + 1 < len(t):
            end = _type_end(t, i + 1)
            kind_words = [y[1] for y in t[i + 1 : end]]
            start = _operand_start(out)
            inner = render(out[start:])
            del out[start:]
            array = "[" in kind_words
            base = kind_words[0].lower()
            if base == "timestamp" and "with" in [y.lower() for y in kind_words]:
                base = "timestamptz"
            exact = "".join(kind_words[1 : kind_words.index(")") + 1]) if base in ("numeric", "decimal") and "(" in kind_words else ""
            target = f"DECIMAL{exact}" if exact else TYPES.get(base, base.upper())
            target = f"ARRAY<{target}>" if array else target
            whole = target in ("INT", "BIGINT", "SMALLINT")
            out += T(f"coalesce(try_cast(bround(try_cast({inner} AS DOUBLE)) AS {target}), try_cast({inner} AS {target}))" if target in ("INT", "SMALLINT") else f"try_cast({inner} AS {target})" if not whole else f"try_cast(bround(try_cast({inner} AS DECIMAL(38, 10))) AS BIGINT)")
            i = end - 1
        elif x in ("->", "->>", "#>", "#>>"):
            start = _operand_start(out)
            end = _operand_end(t, i + 1)
            inner, key = render(out[start:]), t[i + 1]
            del out[start:]
            if x[0] == "#":
                path = "".join(f"[{k}]" if k.isdigit() else f".{k}" for k in literal(key[1]).strip("{}").split(","))
            else:
                path = f"[{key[1]}]" if key[0] == "number" else "." + literal(key[1])
            out += T(f"get_json_object({inner}, {quoted('$' + path)})")
            i = end - 1
        elif x in ("@>", "<@"):
            start, end = _operand_start(out), _operand_end(t, i + 1)
            left, right = render(out[start:]), render_all(t[i + 1 : end])
            del out[start:]
            outer, inner = (left, right) if x == "@>" else (right, left)
            if "array(" in left + right or "ARRAY<" in left + right:
                out += T(f"(size(array_except({inner}, {outer})) = 0)")
            else:
                out += T(f"tl_json_contains({outer}, {inner})")
            i = end - 1
        elif x in ("~", "!~", "~*", "!~*"):
            start, end = _operand_start(out), _operand_end(t, i + 1)
            left, right = render(out[start:]), render_all(t[i + 1 : end])
            del out[start:]
            out += T(f"({'NOT ' if x[0] == '!' else ''}regexp_like({left}, {chr(39) + '(?i)' + chr(39) + ' || ' if x[-1] == '*' else ''}{right}))")
            i = end - 1
        elif low == "any" and after == "(" and out and out[-1][1] == "=":
            end = matching(t, i + 1)
            out.pop()
            start = _operand_start(out)
            left = render(out[start:])
            del out[start:]
            out += T(f"array_contains({render_all(t[i + 2 : end])}, {left})")
            i = end
        elif low == "cast" and after == "(" and (cut := _top_as(t, i + 2, matching(t, i + 1))) >= 0:
            end = matching(t, i + 1)
            t = [*t[:i], ("op", "("), *t[i + 2 : cut], ("op", ")"), ("op", "::"), *t[cut + 1 : end], *t[end + 1 :]]
            continue
        elif low in ("unnest", "generate_series", "jsonb_array_elements", "json_array_elements", "jsonb_array_elements_text", "json_array_elements_text", "regexp_split_to_table") and after == "(":
            end = matching(t, i + 1)
            out += T(table_function(low, [render_all(a) for a in split_top(t[i + 2 : end])], False)[0])
            i = end
        elif low == "interval" and i + 1 < len(t) and t[i + 1][0] == "text":
            parts = interval(literal(t[i + 1][1]))
            if not parts:
                raise ValueError(f"22007: interval {t[i + 1][1]} is not understood")
            sign = out[-1][1] if out and out[-1][1] in ("+", "-") else "+"
            out += T(f" {sign} ".join(parts))
            i += 1
        elif low == "string_agg" and after == "(" and (cut := _top_order(t, i + 2, matching(t, i + 1))) >= 0:
            end = matching(t, i + 1)
            out += T(f"listagg({render_all(t[i + 2 : cut])}) WITHIN GROUP (ORDER BY {render_all(t[cut + 2 : end])})")
            i = end
        elif low == "concat" and after == "(":
            end = matching(t, i + 1)
            out += T(f"concat_ws('', {render_all(t[i + 2 : end])})")
            i = end
        elif low in ("substr", "substring") and after == "(" and not any(word(t, j) == "from" for j in range(i + 2, matching(t, i + 1))):
            end = matching(t, i + 1)
            args = [render_all(a) for a in split_top(t[i + 2 : end])]
            out += T(f"substr({args[0]}, greatest({args[1]}, 1){', ' + args[2] if len(args) > 2 else ''})")
            i = end
        elif low in ("trim", "btrim", "ltrim", "rtrim") and after == "(":
            end = matching(t, i + 1)
            out += T(_trim(low, t[i + 2 : end]))
            i = end
        elif low in ("current_user", "session_user") and after != "(":
            out += T("current_user()")
        elif low in ("current_catalog", "current_role") and after != "(":
            out += T("'default'" if low == "current_catalog" else "current_user()")
        elif low in ("pg_sleep", "current_schemas", "format_type", "pg_get_userbyid", "pg_table_is_visible", "pg_get_expr", "pg_get_constraintdef", "pg_get_indexdef", "obj_description", "col_description", "pg_backend_pid", "has_table_privilege", "has_schema_privilege", "pg_encoding_to_char") and after == "(":
            end = matching(t, i + 1)
            out += T(_system_function(low, [render_all(a) for a in split_top(t[i + 2 : end])]))
            i = end
        elif low == "groups" and word(t, i + 1) in ("between", "unbounded", "current") or (low == "groups" and i + 2 < len(t) and word(t, i + 2) in ("preceding", "following")):
            raise ValueError("0A000: a GROUPS frame needs a query of one table or subquery, without GROUP BY")
        elif low == "date_trunc" and after == "(":
            end = matching(t, i + 1)
            out += T(f"CAST(date_trunc({render_all(t[i + 2 : end])}) AS TIMESTAMP_NTZ)")
            i = end
        elif low in ("now", "current_database", "current_schema", "version") and after == "(":
            out += T({"now": "current_timestamp()", "current_database": "'default'", "current_schema": "'public'", "version": "'PostgreSQL 18 (compatible)'"}[low])
            i = matching(t, i + 1)
        elif low in ("from", "join") or (x == "," and _in_from(out)):
            made = _from_item(t, i)
            if made:
                lateral, end = made
                if low == "join" and out and out[-1][1].upper() in ("LEFT", "OUTER"):
                    while out[-1][1].upper() in ("LEFT", "OUTER"):
                        out.pop()
                    out += T(f"LATERAL VIEW OUTER {lateral[0]} {lateral[1]} AS {', '.join(lateral[2])}")
                    i = _skip_on(t, end) - 1
                elif low == "from":
                    out += T(f"FROM (SELECT {lateral[0]} AS ({', '.join(lateral[2])})) {lateral[1]}") if not lateral[3] else T(f"FROM (SELECT {lateral[3]} FROM (SELECT {lateral[0]} AS ({', '.join(lateral[4])}))) {lateral[1]}")
                    i = end - 1
                else:
                    if low == "join" and out and out[-1][1].upper() in ("CROSS", "INNER"):
                        out.pop()
                    out += T(f"LATERAL VIEW {lateral[0]} {lateral[1]} AS {', '.join(lateral[2])}")
                    i = _skip_on(t, end) - 1
            else:
                out.append(t[i])
        elif low in RENAMED and after == "(":
            out.append(("name", RENAMED[low]))
        else:
            out.append(t[i])
        i += 1
    return render(out)


def _in_from(out: list[tuple[str, str]]) -> bool:
    depth = 0
    for kind, x in reversed(out):
        if x in (")", "]"):
            depth += 1
        elif x in ("(", "["):
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and kind in ("name", "raw"):
            head = x.split()[0].upper() if x.split() else ""
            if head in ("FROM", "LATERAL"):
                return True
            if head in ("SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "BY", "SET", "VALUES"):
                return False
    return False


def _from_item(t: list[tuple[str, str]], i: int):
    """A set-returning function after FROM, JOIN or a comma: ((generator, alias, columns, outer projection, inner columns), end)."""
    j = i + 1
    if word(t, j) == "lateral":
        j += 1
    name = word(t, j)
    if not name or j + 1 >= len(t) or t[j + 1][1] != "(":
        return None
    end = matching(t, j + 1)
    args = [render_all(a) for a in split_top(t[j + 2 : end])]
    end += 1
    ordinal = word(t, end) == "with" and word(t, end + 1) == "ordinality"
    end += 2 * ordinal
    made = table_function(name, args, ordinal)
    if not made:
        return None
    generator, width = made
    alias, columns = name, None
    if word(t, end) == "as":
        end += 1
    if word(t, end) and word(t, end) not in ("where", "join", "left", "right", "full", "inner", "cross", "on", "order", "group", "having", "limit", "union", "intersect", "except", "offset"):
        alias = t[end][1]
        end += 1
        if end < len(t) and t[end][1] == "(":
            close = matching(t, end)
            columns = [render(c) for c in split_top(t[end + 1 : close])]
            end = close + 1
    if columns is None:
        columns = [alias] if width == 1 else [f"{alias}_{k}" for k in range(1, width + 1)]
        columns += ["ordinality"] * ordinal
    if ordinal:
        names = columns[:width]
        inner = ["tl_at", names[0]] if width == 1 else ["tl_at", "tl_row"]
        spread = names if width == 1 else [f"tl_row.`{k}` AS {n}" for k, n in enumerate(names)]
        projection = ", ".join([*spread, f"CAST(tl_at + 1 AS BIGINT) AS {columns[width]}"])
        return (generator, alias, inner, projection, inner), end
    return (generator, alias, columns, "", columns), end


def _skip_on(t: list[tuple[str, str]], at: int) -> int:
    return at + 2 if word(t, at) == "on" and word(t, at + 1) == "true" else at


def _fetch(t: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """FETCH FIRST n ROWS ONLY as LIMIT n, LIMIT m, n as LIMIT n OFFSET m."""
    out, i = [], 0
    while i < len(t):
        if word(t, i) == "fetch" and word(t, i + 1) in ("first", "next"):
            n = t[i + 2] if t[i + 2][0] == "number" else ("number", "1")
            at = len(out) - 2 if word(out, len(out) - 2) == "offset" else len(out)
            out[at:at] = [("name", "LIMIT"), n]
            while i < len(t) and word(t, i) != "only":
                i += 1
        elif word(t, i) == "limit" and i + 3 < len(t) and t[i + 2][1] == ",":
            out += [t[i], t[i + 3], ("name", "OFFSET"), t[i + 1]]
            i += 3
        elif word(t, i) == "rows" and out and word(out, len(out) - 2) == "offset":
            pass
        else:
            out.append(t[i])
        i += 1
    return out


def _limited(t: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Subqueries with ORDER BY and LIMIT or OFFSET select what they are ordered by: where one is correlated, Spark numbers its rows for each
    outer row, and does so in no order if the sort needs a column that isn't selected."""
    out, i = [], 0
    while i < len(t):
        if t[i] != ("op", "("):
            out.append(t[i])
            i += 1
            continue
        end = matching(t, i)
        body = _limited(t[i + 1 : end])
        out += [t[i], *(_keyed(body) if word(body, 0) in ("select", "with") else body), t[end]]
        i = end + 1
    return out


def _keyed(t: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A query with ORDER BY and LIMIT or OFFSET as one over a query that also selects those keys which are not among its columns."""
    depth, marks = 0, {}
    for i, (kind, x) in enumerate(t):
        if kind == "op":
            depth += x in "(["
            depth -= x in ")]"
        if depth == 0 and word(t, i) in ("select", "from", "union", "intersect", "except", *LIST_ENDS) and (word(t, i), word(t, i - 1)) != ("from", "distinct"):
            marks.setdefault(word(t, i), i)
    if "select" not in marks or "order" not in marks or not {"limit", "offset"} & marks.keys() or {"union", "intersect", "except"} & marks.keys():
        return t
    start = marks["select"] + 1
    if word(t, start) == "distinct":
        return t  # its keys must be selected
    stop = min(i for k, i in marks.items() if i >= start)
    order, tail = marks["order"] + 2, min(marks[k] for k in ("limit", "offset") if k in marks)
    columns = {plain_name(item[-1][1]) for item in split_top(t[start:stop]) if item[-1][0] == "name" and default_name(item) is None}
    keys, by = [], []
    for item in split_top(t[order:tail]):
        cut = len(item) - 2 * (word(item, len(item) - 2) == "nulls")
        cut -= word(item, cut - 1) in ("asc", "desc")
        key, way = item[:cut], item[cut:]
        if not (len(key) == 1 and (key[0][0] == "number" or plain_name(key[0][1]) in columns)):
            key, name = [("name", f"tl_key{len(keys)}")], key
            keys.append([("op", ","), *name, ("name", "AS"), *key])
        by += [("op", ",")] * bool(by) + key + way
    if not keys:
        return t
    inner = [*t[:stop], *(x for k in keys for x in k), *t[stop:order], *by, *t[tail:]]
    return [("name", "SELECT"), ("raw", f"* EXCEPT ({', '.join(k[-1][1] for k in keys)})"), ("name", "FROM"), ("op", "("), *inner, ("op", ")")]


def _groups(t: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """GROUPS frames of a query's select list as RANGE frames over peer numbers, which an inner query counts; of one table or subquery."""
    if word(t, 0) != "select" or not any(word(t, i) == "groups" for i in range(len(t))):
        return t
    depth, marks = 0, {}
    for i, (kind, x) in enumerate(t):
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if depth == 0 and kind == "name" and x.lower() in ("from", "where", "group", "having", "order", "limit", "offset", "union", "intersect", "except"):
            marks.setdefault(x.lower(), i)
    if "from" not in marks or {"group", "having", "union", "intersect", "except"} & marks.keys():
        return t
    stop = min((marks[k] for k in ("order", "limit", "offset") if k in marks), default=len(t))
    source = t[marks["from"] + 1 : marks.get("where", stop)]
    at = matching(source, 0) + 1 if source[0][1] == "(" else 1 + 2 * (len(source) > 1 and source[1][1] == ".")
    at += word(source, at) == "as"
    if len(source) > at + 1:
        return t  # a join
    alias = source[at] if at < len(source) else source[-1]
    items, peers, out, i = t[1 : marks["from"]], [], [], 0
    while i < len(items):
        if word(items, i) == "over" and items[i + 1][1] == "(":
            end = matching(items, i + 1)
            body = items[i + 2 : end]
            frame = next((k for k in range(len(body)) if word(body, k) == "groups"), -1)
            order = next((k for k in range(len(body)) if word(body, k) == "order"), -1)
            if 0 <= order < frame:
                key = tuple(body[:frame])
                if key not in peers:
                    peers.append(key)
                number = ("name", f"tl_peer{peers.index(key)}")
                out += [items[i], ("op", "("), *body[:order], ("name", "ORDER"), ("name", "BY"), number, ("name", "RANGE"), *body[frame + 1 :], ("op", ")")]
                i = end + 1
                continue
        out.append(items[i])
        i += 1
    if not peers:
        return t
    ranks = ", ".join(f"dense_rank() OVER ({render_all(list(k))}) AS tl_peer{n}" for n, k in enumerate(peers))
    inner = f"FROM (SELECT *, {ranks} {render_all(t[marks['from'] : stop])}) AS {render([alias])}"
    return [t[0], *out, *T(inner), *t[stop:]]


def _distinct_on(t: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """SELECT DISTINCT ON (keys) items FROM ... ORDER BY ... at the top level, by row_number."""
    if not (word(t, 0) == "select" and word(t, 1) == "distinct" and word(t, 2) == "on"):
        return t
    close = matching(t, 3)
    keys, rest = render_all(t[4:close]), t[close + 1 :]
    depth, start, order = 0, None, len(rest)
    for i, (kind, x) in enumerate(rest):
        depth += x in ("(", "[")
        depth -= x in (")", "]")
        if depth == 0 and word(rest, i) == "from" and start is None:
            start = i
        if depth == 0 and word(rest, i) == "order" and word(rest, i + 1) == "by":
            order = i
            break
    items = [p for p in split_top(rest[:start])]
    names = [render(p[-1:]) for p in items]
    by = render_all(rest[order + 2 :]) if order < len(rest) else keys
    select = ", ".join(f"{render_all(p[:-2] if word(p, len(p) - 2) == 'as' else p)} AS {n}" for p, n in zip(items, names))
    body = render_all(rest[start:order])
    return [("raw", f"SELECT {', '.join(names)} FROM (SELECT {select}, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS tl_rank {body}) WHERE tl_rank = 1")]


LIST_ENDS = frozenset("from where group having order limit offset fetch union intersect except window qualify into".split())
MAX_NESTING = 100


def nesting(t: list[tuple[str, str]]) -> int:
    """How deep queries lie in each other."""
    open_, deepest = [], 0
    for i, (kind, x) in enumerate(t):
        if kind == "op" and x == "(":
            open_.append(word(t, i + 1) in ("select", "with", "values"))
            deepest = max(deepest, sum(open_))
        elif kind == "op" and x == ")" and open_:
            open_.pop()
    return deepest


def default_name(item: list[tuple[str, str]]) -> str | None:
    """PostgreSQL's name of a select item without an alias, None if Spark's own is the same."""
    if not item or item[-1][1] == "*":
        return None
    if len(item) > 1 and word(item, len(item) - 2) == "as":
        return None
    last = item[-1]
    if last[0] == "name" and len(item) > 1:
        if item[-2][1] == ".":
            return None
        before = item[:-1]
        if last[1].lower() not in KEYWORDS and _ends_operand(before) and _operand_start(before) == 0 or (last[1].lower() not in KEYWORDS and _ends_operand(before) and before[-1][1] not in (".", "::")):
            return None  # an alias without AS
    if len(item) == 1:
        return None if last[0] == "name" and last[1].lower() not in KEYWORDS and last[1].lower() not in ("current_user", "session_user", "current_date", "current_timestamp") else last[1].lower() if last[0] == "name" and last[1].lower() not in ("null", "true", "false") else "?column?"
    head = item
    while len(head) > 2 and any(x == "::" for _, x in head) and _operand_start(head) == 0:
        cut = max(i for i, (_, x) in enumerate(head) if x == "::")
        head = head[:cut]
        if len(head) == 1 or head[-1][0] == "name":
            return plain_name(head[-1][1]) if head[-1][0] == "name" else TYPE_NAMES.get(word(item, cut + 1), word(item, cut + 1))
    if word(head, 0) == "case" and _operand_start(head) == 0:
        return "case"
    if word(head, 0) == "cast" and head[1][1] == "(" and matching(head, 1) == len(head) - 1:
        inner = head[2]
        return plain_name(inner[1]) if inner[0] == "name" and word(head, 3) == "as" else TYPE_NAMES.get(word(head, len(head) - 2), word(head, len(head) - 2))
    if head[0][0] == "name" and word(head, 0) not in KEYWORDS and len(head) > 1 and head[1][1] == "(" and _operand_start(head) == 0:
        return plain_name(head[0][1])
    return "?column?"


TYPE_NAMES = {"int": "int4", "integer": "int4", "bigint": "int8", "smallint": "int2", "boolean": "bool", "double": "float8", "real": "float4", "decimal": "numeric", "varchar": "varchar", "string": "text"}


def plain_name(x: str) -> str:
    return x[1:-1] if x[0] == '"' else x.lower()


def named(t: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Every select list with PostgreSQL's names for items that have no alias."""
    out, i = [], 0
    while i < len(t):
        if word(t, i) != "select":
            if t[i][0] == "op" and t[i][1] == "(":
                end = matching(t, i)
                out += [t[i], *named(t[i + 1 : end]), t[end]]
                i = end + 1
            else:
                out.append(t[i])
                i += 1
            continue
        out.append(t[i])
        i += 1
        if word(t, i) in ("distinct", "all"):
            out.append(t[i])
            i += 1
            if word(t, i) == "on":
                end = matching(t, i + 1)
                out += t[i : end + 1]
                i = end + 1
        end, depth = i, 0
        while end < len(t):
            if t[end][0] == "op":
                depth += t[end][1] in "(["
                depth -= t[end][1] in ")]"
            if depth < 0 or (depth == 0 and (word(t, end) in LIST_ENDS and (word(t, end), word(t, end - 1)) not in (("from", "distinct"), ("group", "within")) or t[end][1] == ";")):
                break
            end += 1
        for k, item in enumerate(split_top(t[i:end])):
            name = default_name(item)
            out += [("op", ",")] * (k > 0) + named(item) + ([("name", "AS"), ("name", '"' + name.replace('"', '""') + '"')] if name else [])
        i = end
    return out
