"""A SQL session: PostgreSQL-flavoured queries, DML with constraints, DDL, transactions, roles and settings over a Store."""

from __future__ import annotations

import copy
import re
import threading
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import relational
from .plans import dialect, system
from .plans.dialect import matching, render, render_all, split_top, word
from .sources import copy_format
from .sources.storage import SqlError, Store

SETTINGS = {"server_version": "18.0", "timezone": "UTC", "client_encoding": "UTF8", "search_path": "public", "datestyle": "ISO, MDY", "statement_timeout": "0", "lc_collate": "C"}


@dataclass
class Result:
    """A command's tag and, for RETURNING and SHOW, its rows."""

    tag: str
    rows: DataFrame | None = None


def find(t, *words: str, start: int = 0) -> int:
    """The index of a top-level run of words, or -1."""
    depth = 0
    for i in range(start, len(t)):
        if t[i][0] == "op":
            depth += t[i][1] in "(["
            depth -= t[i][1] in ")]"
        if depth == 0 and all(word(t, i + k) == w for k, w in enumerate(words)):
            return i
    return -1


def plain(token) -> str:
    return token[1][1:-1] if token[1][0] == '"' else token[1].lower()


def column_type(t) -> str:
    base = word(t, 0)
    args = render(t[1 : matching(t, 1) + 1]) if len(t) > 1 and t[1][1] == "(" else ""
    kind = f"DECIMAL{args}".replace(" ", "") if base in ("numeric", "decimal") and args else dialect.TYPES.get(base)
    if kind is None:
        raise SqlError("42704", f"type {base} does not exist")
    return f"ARRAY<{kind}>" if any(x == "[" for _, x in t) else kind


def coerced(expression: str, kind: str) -> str:
    """A value as a column takes it: half to even for integers, null where it cannot be read."""
    if kind in ("SMALLINT", "INT", "BIGINT"):
        return f"coalesce(try_cast({expression} AS {kind}), try_cast(bround(try_cast({expression} AS DOUBLE)) AS {kind}))" if not re.search(r"\d\.\d|/", expression) else f"try_cast(bround(try_cast({expression} AS DOUBLE)) AS {kind})"
    return f"CAST({expression} AS {kind})" if kind.startswith("ARRAY") else f"try_cast({expression} AS {kind})"


#: The resource of rights that are no table's or schema's: ALL on it makes a superuser.
SYSTEM = "system"
#: Decisions that a session's audit keeps.
AUDITED = 10_000


@dataclass
class Decision:
    """One check of a right."""

    role: str | None
    action: str
    resource: str
    allowed: bool
    reason: str


class Portal:
    """The rows of a query in parts: they are computed partition by partition as they are asked for, and never held all at once."""

    def __init__(self, df: DataFrame) -> None:
        self.schema, self._rows = df.schema, df.toLocalIterator()

    def fetch(self, most: int) -> list:
        """The next rows, ``most`` of them at most; none at the end."""
        out = []
        while len(out) < most and (row := next(self._rows, None)) is not None:
            out.append(row)
        return out

    def __iter__(self) -> Iterator:
        return self._rows


class Session:
    """``role`` None or postgres may do anything; any other role only what it, or a role it is in, was granted or owns."""

    def __init__(self, spark: SparkSession, root: str, role: str | None = None) -> None:
        self.spark = spark.newSession()
        for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.spark.conf.set(k, spark.conf.get(k))
        self.store, self.role = Store(spark, root), role
        self.settings, self.savepoints, self.open, self.failed = dict(SETTINGS), [], False, False
        self.audit: deque[Decision] = deque(maxlen=AUDITED)
        self.portals: dict[str, Portal] = {}
        self._made: set[str] = set()  # views that stand for tables, of this statement
        self._unchecked = 0  # how many views deep: what a view reads is its owner's right
        system.register(self.spark)
        self._pin()

    # -- state ---------------------------------------------------------------------------------------------------

    def _pin(self) -> None:
        self.base = self.store.latest()
        self.before = self.store.read(self.base)
        self.state = copy.deepcopy(self.before)

    def _publish(self) -> None:
        changed = any(self.state[k] != self.before[k] for k in ("tables", "schemas", "roles", "grants"))
        if changed:
            self.store.commit(self.base, self.before, self.state)
        self._pin()

    def _name(self, t, at: int) -> tuple[str, int]:
        """A table name at a token: (key, one past it)."""
        if at + 2 < len(t) and t[at + 1][1] == ".":
            schema, name, end = plain(t[at]), plain(t[at + 2]), at + 3
            return (name if schema == "public" else f"{schema}.{name}"), end
        return plain(t[at]), at + 1

    def _table(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise SqlError("42P01", f"relation {name} does not exist")
        return self.state["tables"][name]

    def _roles(self) -> set[str]:
        """The session's role and those it is in, directly or not."""
        found, left = set(), [self.role]
        while left:
            r = left.pop()
            if r not in found:
                found.add(r)
                left += self.state["roles"].get(r, {}).get("of", [])
        return found

    def _allow(self, action: str, name: str, what: str = "table") -> None:
        """Raise unless the role may do this: nothing is allowed by default, and every decision is audited."""
        if self._unchecked:
            return
        roles, reason = self._roles(), ""
        rights = {(g[0], g[1]) for g in self.state["grants"] if g[2] in roles}
        owner = self.state["tables"].get(name, {}).get("owner") if what == "table" else None
        if self.role in (None, "postgres") or ("ALL", SYSTEM) in rights:
            reason = "superuser"
        elif owner is not None and owner in roles:
            reason = "owner"
        elif rights & {(action, name), ("ALL", name)}:
            reason = "granted"
        self.audit.append(Decision(self.role, action, name, bool(reason), reason or "not granted"))
        if not reason:
            raise SqlError("42501", f"permission denied for {what} {name}")

    def _schema_of(self, name: str) -> str:
        return name.split(".")[0] if "." in name else "public"

    def frame(self, name: str) -> DataFrame:
        """The rows of a table or view in this session's state."""
        meta = self._table(name)
        if meta["view"]:
            self._unchecked += 1
            try:
                return self._select(dialect.tokens(meta["view"]))
            finally:
                self._unchecked -= 1
        schema = ", ".join(f"`{c['name']}` {c['type']}" for c in meta["columns"])
        return self.spark.read.schema(schema).parquet(*meta["data"]) if meta["data"] else self.spark.createDataFrame([], schema)

    # -- statements ----------------------------------------------------------------------------------------------

    def sql(self, text: str, params: list | None = None) -> DataFrame | Result:
        """Run one statement; outside of BEGIN it is a transaction of its own."""
        t = dialect.tokens(text)
        while t and t[-1][1] == ";":
            t.pop()
        head = word(t, 0)
        if self.failed and head not in ("rollback", "commit", "end"):
            raise SqlError("25P02", "the transaction is aborted; ROLLBACK first")
        try:
            if head in ("begin", "start", "commit", "end", "rollback", "abort", "savepoint", "release"):
                return self._transaction(t, head)
            if not self.open:
                self._pin()
            for view in self._made:
                self.spark.catalog.dropTempView(view)
            self._made.clear()
            if dialect.nesting(t) > dialect.MAX_NESTING:
                raise SqlError("54001", f"queries are nested more than {dialect.MAX_NESTING} deep")
            with self._timed(t):
                done = self._copy(text) if head == "copy" else self._statement(t, head, params)
            if not self.open:
                self._publish()
            return done
        except Exception:
            if self.open:
                self.failed = True
            else:
                self.state = copy.deepcopy(self.before)
            raise

    @contextmanager
    def _timed(self, t) -> Iterator[None]:
        """Cancel what a statement runs after statement_timeout milliseconds (0: never).  A query's rows are computed later, when they
        are asked for, and are not timed; pg_sleep does not sleep, and is only held against the timeout."""
        digits = re.match(r"(\d+)\s*(ms|s|min)?$", self.settings["statement_timeout"])
        wait = int(digits[1]) * {"s": 1000, "min": 60_000}.get(digits[2], 1) if digits else 0
        late = SqlError("57014", "canceling statement due to statement timeout")
        for i in range(len(t) - 2):
            if wait and word(t, i) == "pg_sleep" and t[i + 2][0] == "number" and float(t[i + 2][1]) * 1000 > wait:
                raise late
        if not wait:
            yield
            return
        context, group, fired = self.spark.sparkContext, f"tarnlake-{uuid.uuid4().hex}", threading.Event()
        timer = threading.Timer(wait / 1000, lambda: (fired.set(), context.cancelJobGroup(group)))
        context.setJobGroup(group, "statement", True)
        timer.start()
        try:
            yield
        except SqlError:
            raise
        except Exception as e:
            if fired.is_set():
                raise late from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def portal(self, text: str, params: list | None = None) -> Portal:
        """A query whose rows are fetched in parts."""
        return Portal(self.sql(text, params))

    def stream(self, text: str, sink, params: list | None = None) -> int:
        """Hand every row of a query to sink(row) as it is computed; returns how many there were."""
        n = 0
        for row in self.portal(text, params):
            sink(row)
            n += 1
        return n

    def _transaction(self, t, head: str) -> Result:
        if head in ("begin", "start"):
            if self.open:
                raise SqlError("25001", "a transaction is already open")
            self._pin()
            self.open = True
            return Result("BEGIN")
        if head == "savepoint":
            if not self.open:
                raise SqlError("25P01", "SAVEPOINT needs a transaction")
            self.savepoints.append((plain(t[1]), copy.deepcopy(self.state)))
            return Result("SAVEPOINT")
        if head == "release" or (head == "rollback" and find(t, "to") > 0):
            name = plain(t[-1])
            at = max((i for i, (n, _) in enumerate(self.savepoints) if n == name), default=-1)
            if at < 0:
                raise SqlError("3B001", f"savepoint {name} does not exist")
            if head == "release":
                del self.savepoints[at:]
                return Result("RELEASE")
            self.state, self.failed = copy.deepcopy(self.savepoints[at][1]), False
            del self.savepoints[at + 1 :]
            return Result("ROLLBACK")
        commit = head in ("commit", "end") and not self.failed
        self.open, self.failed, self.savepoints = False, False, []
        self.portals.clear()
        if commit:
            try:
                self._publish()
            except SqlError:
                self._pin()
                raise
            return Result("COMMIT")
        self._pin()
        return Result("ROLLBACK")

    def _statement(self, t, head: str, params) -> DataFrame | Result:
        if head in ("select", "with", "values") or t[0][1] == "(":
            return self._select(t, params)
        if head == "explain":
            plan = self._select(t[1:], params)._sc._jvm.PythonSQLUtils.explainString(self._select(t[1:], params)._jdf.queryExecution(), "formatted")
            return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "`QUERY PLAN` string")
        made = {"insert": self._insert, "update": self._update, "delete": self._delete, "truncate": self._truncate, "create": self._create, "drop": self._drop, "alter": self._alter, "grant": self._grant, "revoke": self._grant, "set": self._set, "show": self._show, "discard": self._discard, "deallocate": self._discard, "declare": self._cursor, "fetch": self._cursor, "move": self._cursor, "close": self._cursor, "vacuum": self._vacuum}.get(head)
        if made is None:
            raise SqlError("42601", f"statement {head.upper()} is not supported")
        return made(t)

    # -- queries -------------------------------------------------------------------------------------------------

    def _views(self, t) -> list:
        """Register what the tokens name, and return them with schema-qualified names joined."""
        out, i = [], 0
        while i < len(t):
            if t[i][0] == "name":
                first = plain(t[i])
                if i + 2 < len(t) and t[i + 1][1] == "." and t[i + 2][0] == "name":
                    second = plain(t[i + 2])
                    key = second if first == "public" else f"{first}.{second}"
                    if first in ("information_schema", "pg_catalog") and second in system.RELATIONS:
                        self._register(system.relation(self.spark, self.state, self.settings, second), second)
                        out.append(("name", second))
                        i += 3
                        continue
                    if key in self.state["tables"] and (first == "public" or first in self.state["schemas"]):
                        self._allow("SELECT", key)
                        view = key.replace(".", "__")
                        self._register(self.frame(key), view)
                        out.append(("name", view))
                        i += 3
                        continue
                previous = word(t, i - 1) if i else ""
                named = previous in ("from", "join", "table", "only", "lateral", "using") or (i and ((t[i - 1][1] == "," and dialect._in_from(out)) or (t[i - 1][1] == "(" and word(t, i - 2) in ("from", "join"))))
                if named and first in self.state["tables"] and (i + 1 == len(t) or t[i + 1][1] != "("):
                    self._allow("SELECT", first)
                    self._register(self.frame(first), first)
                elif first.startswith("pg_") and first in system.RELATIONS and previous in ("from", "join"):
                    self._register(system.relation(self.spark, self.state, self.settings, first), first)
            out.append(t[i])
            i += 1
        return out

    def _register(self, df: DataFrame, view: str) -> None:
        df.createOrReplaceTempView(view)
        self._made.add(view)

    def _text(self, t) -> str:
        """An expression or clause as Spark SQL; tables it names are read as they are now, if the role may read them."""
        return render_all(self._views(t))

    def _select(self, t, params: list | None = None) -> DataFrame:
        t = dialect.named(self._views(t))
        if word(t, 0) == "with" and word(t, 1) == "recursive":
            found = self._recursive(t, params)
            if found is not None:
                return found
        args = {f"p{i}": v for i, v in enumerate(params or [], 1)}
        text = render_all(t)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _recursive(self, t, params) -> DataFrame | None:
        """WITH RECURSIVE r (cols) AS (seed UNION term) query, distinct rows; None if it is a UNION ALL (Spark's own)."""
        name, at, columns = plain(t[2]), 3, None
        if t[at][1] == "(":
            close = matching(t, at)
            columns, at = [plain(c[0]) for c in split_top(t[at + 1 : close])], close + 1
        close = matching(t, at + 1)
        body, rest = t[at + 2 : close], t[close + 1 :]
        union = find(body, "union")
        if union < 0 or word(body, union + 1) == "all" or (rest and rest[0][1] == ","):
            return None
        seed = self._select(body[:union], params)
        seed = seed.toDF(*columns) if columns else seed
        term = body[union + 1 :]

        def step(new: DataFrame) -> DataFrame:
            self._register(new, name)
            return self.spark.sql(render_all(term))

        self._register(relational.recursive_union(seed, step), name)
        return self._select(rest, params)

    # -- data changes --------------------------------------------------------------------------------------------

    def _insert(self, t) -> Result:
        name, at = self._name(t, 2)
        meta = self._table(name)
        self._allow("INSERT", name)
        columns = [c["name"] for c in meta["columns"]]
        kinds = {c["name"]: c["type"] for c in meta["columns"]}
        defaults = {c["name"]: c["default"] or "NULL" for c in meta["columns"]}
        listed, named = columns, False
        if at < len(t) and t[at][1] == "(" and word(t, at + 1) not in ("select", "with"):
            named = True
            close = matching(t, at)
            listed, at = [plain(c[0]) for c in split_top(t[at + 1 : close])], close + 1
            for c in listed:
                if c not in columns:
                    raise SqlError("42703", f"column {c} of {name} does not exist")
        returning, conflict = find(t, "returning", start=at), find(t, "on", "conflict", start=at)
        stop = min(x for x in (returning, conflict, len(t)) if x >= 0)
        source = t[at:stop]
        if word(source, 0) == "default":
            rows = self.spark.sql("SELECT " + ", ".join(f"{coerced(self._text(dialect.tokens(defaults[c])), kinds[c])} AS `{c}`" for c in columns))
        elif word(source, 0) == "values":
            lines = []
            for row in split_top(source[1:]):
                cells = split_top(row[1:-1])
                if len(cells) > len(listed):
                    raise SqlError("42601", "INSERT has more expressions than target columns")
                given = {c: defaults[c] if word(x, 0) == "default" and len(x) == 1 else None for c, x in zip(listed, cells)}
                exact = {c: self._text(dialect.tokens(given[c]) if given[c] is not None else x) for c, x in zip(listed, cells)}
                lines.append("SELECT " + ", ".join(f"{coerced(exact.get(c, render_all(dialect.tokens(defaults[c]))), kinds[c])} AS `{c}`" for c in columns))
            rows = self.spark.sql(" UNION ALL ".join(lines))
        else:
            got = self._select(source)
            width = len(got.columns)
            if width > len(listed) or (named and width < len(listed)):
                raise SqlError("42601", "INSERT has another number of expressions than target columns")
            # without a list of columns the query fills the first ones, the others get their defaults
            got.toDF(*[f"v{i}" for i in range(width)]).createOrReplaceTempView("tl_source")
            where = {c: f"v{i}" for i, c in enumerate(listed[:width])}
            rows = self.spark.sql("SELECT " + ", ".join(f"{coerced(where.get(c) or render_all(dialect.tokens(defaults[c])), kinds[c])} AS `{c}`" for c in columns) + " FROM tl_source")
        path = self.store.write_data(rows)
        added = self.spark.read.schema(rows.schema).parquet(path)
        if conflict >= 0:
            end = returning if returning >= 0 else len(t)
            added, n = self._upsert(name, meta, added, t[conflict + 2 : end])
        else:
            self._checked(name, meta, added, columns, fresh=True)
            meta["data"] = [*meta["data"], path]
            n = added.count()
        return Result(f"INSERT 0 {n}", self._returning(t, returning, added, name))

    def _returning(self, t, at: int, rows: DataFrame, name: str) -> DataFrame | None:
        if at < 0:
            return None
        rows.createOrReplaceTempView("tl_affected")
        return self.spark.sql(f"{render_all(dialect.named([('name', 'SELECT'), *self._bare(self._views(t[at + 1 :]), name), ('name', 'FROM'), ('name', 'tl_affected')]))}")

    def _upsert(self, name: str, meta: dict, rows: DataFrame, t) -> tuple[DataFrame, int]:
        at, key = 0, next((k["columns"] for k in meta["keys"] if k["primary"]), None)
        if t and t[0][1] == "(":
            close = matching(t, 0)
            key, at = [plain(c[0]) for c in split_top(t[1:close])], close + 1
        if key is None or not any(set(k["columns"]) == set(key) for k in meta["keys"]):
            raise SqlError("42P10", "no unique constraint matches the ON CONFLICT target")
        old, columns = self.frame(name), [c["name"] for c in meta["columns"]]
        same = lambda a, b: " AND ".join(f"{a}.`{k}` = {b}.`{k}`" for k in key)
        rows.createOrReplaceTempView("tl_new")
        old.createOrReplaceTempView("tl_old")
        new = self.spark.sql(f"SELECT n.* FROM tl_new n LEFT ANTI JOIN tl_old o ON {same('n', 'o')}")
        if word(t, at + 1) == "nothing":
            keyed = new.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).dropDuplicates(key)
            path = self.store.write_data(keyed.unionByName(new.where(" OR ".join(f"`{k}` IS NULL" for k in key))))
            added = self.spark.read.schema(rows.schema).parquet(path)
            self._checked(name, meta, added, columns, fresh=True)
            meta["data"] = [*meta["data"], path]
            return added, added.count()
        if not rows.groupBy(*key).count().where("count > 1").where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).isEmpty():
            raise SqlError("21000", "ON CONFLICT DO UPDATE cannot affect a row a second time")
        where = find(t, "where", start=at)
        sets = self._assignments(meta, t[at + 3 : where if where >= 0 else len(t)], name)
        condition = self._text(self._bare(t[where + 1 :], name)) if where >= 0 else "TRUE"
        renamed = ", ".join(f"`{c}` AS `excluded__{c}`" for c in columns)
        joined = self.spark.sql(f"SELECT o.*, n.* FROM tl_old o JOIN (SELECT {renamed} FROM tl_new) n ON " + " AND ".join(f"o.`{k}` = n.`excluded__{k}`" for k in key))
        joined.createOrReplaceTempView("tl_joined")
        kinds = {c["name"]: c["type"] for c in meta["columns"]}
        changed = self.spark.sql("SELECT " + ", ".join(f"{coerced(sets[c], kinds[c])} AS `{c}`" if c in sets else f"`{c}`" for c in columns) + f" FROM tl_joined WHERE {condition}")
        touched = self.spark.sql("SELECT " + ", ".join(f"`{k}`" for k in key) + f" FROM tl_joined WHERE {condition}")
        path, rest = self.store.write_data(changed.unionByName(new)), self.store.write_data(old.join(touched, key, "left_anti").select(columns))
        affected = self.spark.read.schema(rows.schema).parquet(path)
        meta["data"] = [rest, path]
        self._checked(name, meta, affected, columns, fresh=False)
        return affected, affected.count()

    def _bare(self, t, name: str) -> list:
        """Tokens with the table's own name dropped from qualified columns, and EXCLUDED.c made one name."""
        out, i = [], 0
        while i < len(t):
            if i + 2 < len(t) and t[i + 1][1] == "." and t[i][0] == "name" and plain(t[i]) in (name, "excluded"):
                out.append(("name", plain(t[i + 2]) if plain(t[i]) == name else f"excluded__{plain(t[i + 2])}"))
                i += 3
            else:
                out.append(t[i])
                i += 1
        return out

    def _assignments(self, meta: dict, t, name: str) -> dict[str, str]:
        defaults = {c["name"]: c["default"] or "NULL" for c in meta["columns"]}
        sets = {}
        for part in split_top(t):
            c = plain(part[0])
            if c not in defaults:
                raise SqlError("42703", f"column {c} of {name} does not exist")
            sets[c] = render_all(dialect.tokens(defaults[c])) if word(part, 2) == "default" and len(part) == 3 else self._text(self._bare(part[2:], name))
        return sets

    @staticmethod
    def _placed(base: DataFrame) -> DataFrame:
        """The rows of a table's files with their place ``tl_at``: the number of the file, by the order of paths, and 40 bits for the row in it.
        Paths, much larger in memory than their compressed size tells, stay out of what is joined."""
        path = F.col("_metadata.file_path").alias("tl_file")
        files = base.select(path).distinct().select("tl_file", F.row_number().over(Window.orderBy("tl_file")).cast("bigint").alias("tl_number"))
        rows = base.select("*", path, F.col("_metadata.row_index").alias("tl_row")).join(F.broadcast(files), "tl_file")
        return rows.select(*[F.col(f"`{c}`") for c in base.columns], (F.shiftleft("tl_number", 40) + F.col("tl_row")).alias("tl_at"))

    def _hit(self, name: str, condition) -> tuple[DataFrame, DataFrame]:
        """(rows for which the condition is true, all other rows)."""
        base = self.frame(name)
        columns = base.columns
        if not condition:
            return base, base.where("false")
        if not self._table(name)["data"]:
            return base, base
        if any(word(condition, i) == "select" for i in range(len(condition))):
            placed = self._placed(base)
            placed.createOrReplaceTempView("tl_placed")
            hit = self.spark.sql(f"SELECT * FROM tl_placed WHERE {render_all(self._bare(self._views(condition), name))}")
            return hit.select(columns), placed.join(hit.select("tl_at"), "tl_at", "left_anti").select(columns)
        text = self._text(self._bare(condition, name))
        return base.where(text), base.where(f"NOT coalesce({text}, false)")

    def _joined(self, name: str, alias: str, others, condition, sets: dict[str, list], meta: dict, wanted: bool = True) -> tuple[DataFrame, DataFrame]:
        """(rows of the table that meet rows of ``others``, as ``sets`` changes them; all other rows).  A row that meets several is taken once.
        Unless they are wanted, the rows that meet others come without columns."""
        columns = [c["name"] for c in meta["columns"]]
        base = self.frame(name)
        if not meta["data"]:
            return base, base
        placed = self._placed(base)
        self._register(placed, "tl_placed")
        new = "".join(f", {coerced(self._text(sets[c['name']]), c['type'])} AS `tl_{i}`" if c["name"] in sets else f", `{alias}`.`{c['name']}` AS `tl_{i}`" for i, c in enumerate(meta["columns"] if wanted else []))
        source = self._views([("name", "FROM"), *others])[1:]
        text = f"SELECT `{alias}`.tl_at{new} FROM tl_placed AS `{alias}`, {render_all([('name', 'FROM'), *source])[4:]}"
        met = self.spark.sql(text + (f" WHERE {self._text(condition)}" if condition else "")).dropDuplicates(["tl_at"])
        path = self.store.write_data(met)
        met = self.spark.read.schema(met.schema).parquet(path)
        rest = placed.join(met.select("tl_at"), "tl_at", "left_anti").select(columns)
        return met.select(*[F.col(f"tl_{i}").alias(c) for i, c in enumerate(columns if wanted else [])]), rest

    def _update(self, t) -> Result:
        name, at = self._name(t, 1)
        meta = self._table(name)
        self._allow("UPDATE", name)
        alias = name.split(".")[-1]
        if word(t, at) != "set":
            at += word(t, at) == "as"
            alias, at = plain(t[at]), at + 1
        source, where, returning = find(t, "from", start=at), find(t, "where", start=at), find(t, "returning", start=at)
        end = returning if returning >= 0 else len(t)
        stop = min(x for x in (source, where, end) if x >= 0)
        if source >= 0 or alias != name.split(".")[-1]:
            self._assignments(meta, t[at + 1 : stop], name)
            sets = {}
            for part in split_top(t[at + 1 : stop]):
                c = plain(part[0])
                default = next(x["default"] or "NULL" for x in meta["columns"] if x["name"] == c)
                sets[c] = dialect.tokens(default) if word(part, 2) == "default" and len(part) == 3 else part[2:]
            others = t[source + 1 : where if where >= 0 else end] if source >= 0 else dialect.tokens("(SELECT 1 AS tl_one) AS tl_single")
            changed, rest = self._joined(name, alias, others, t[where + 1 : end] if where >= 0 else [], sets, meta)
        else:
            sets = self._assignments(meta, t[at + 1 : stop], name)
            hit, rest = self._hit(name, t[where + 1 : end] if where >= 0 else [])
            self._register(hit, "tl_hit")
            changed = self.spark.sql("SELECT " + ", ".join(f"{coerced(sets[c['name']], c['type'])} AS `{c['name']}`" if c["name"] in sets else f"`{c['name']}`" for c in meta["columns"]) + " FROM tl_hit")
        path, kept = self.store.write_data(changed), self.store.write_data(rest)
        affected = self.spark.read.schema(rest.schema).parquet(path)
        meta["data"] = [kept, path]
        self._checked(name, meta, affected, list(sets), fresh=False)
        return Result(f"UPDATE {affected.count()}", self._returning(t, returning, affected, name))

    def _delete(self, t) -> Result:
        name, at = self._name(t, 2)
        meta = self._table(name)
        self._allow("DELETE", name)
        using, where, returning = find(t, "using"), find(t, "where"), find(t, "returning")
        end = returning if returning >= 0 else len(t)
        alias = plain(t[at + (word(t, at) == "as")]) if at < len(t) and word(t, at) not in ("using", "where", "returning") else name.split(".")[-1]
        condition = t[where + 1 : end] if where >= 0 else []
        if using >= 0 or alias != name.split(".")[-1]:
            others = t[using + 1 : where if where >= 0 else end] if using >= 0 else dialect.tokens("(SELECT 1 AS tl_one) AS tl_single")
            hit, rest = self._joined(name, alias, others, condition, {}, meta, wanted=returning >= 0)
        else:
            hit, rest = self._hit(name, condition)
        n, kept = hit.count(), self.store.write_data(rest)
        gone = self._returning(t, returning, hit, name)
        meta["data"] = [kept]
        return Result(f"DELETE {n}", gone)

    def _copy(self, text: str) -> Result:
        """COPY t [(columns)] FROM 'path' and COPY t or (query) TO 'path', in text, CSV or binary (FROM only) format; copy_in takes data."""
        copy_ = copy_format.parse_copy(text)
        if copy_.path is None:
            raise SqlError("0A000", "COPY from or to the client is Session.copy_in and Session.copy_out")
        if not copy_.to:
            return self._copy_from(copy_, copy_.path)
        if copy_.query:
            rows = self._select(dialect.tokens(copy_.query))
        else:
            name = self._name(dialect.tokens(copy_.table), 0)[0]
            self._allow("SELECT", name)
            rows = self.frame(name).select(copy_.columns or "*")
        if copy_.format == "binary":
            raise SqlError("0A000", "COPY TO writes text and CSV")
        if copy_.format == "csv":
            copy_format.write_csv(rows, copy_.path, copy_.header, copy_.delimiter, copy_.null)
        else:
            copy_format.write_text(rows, copy_.path, copy_.null, copy_.delimiter)
        return Result(f"COPY {rows.count()}")

    def _copy_from(self, copy_: copy_format.Copy, path: str) -> Result:
        name = self._name(dialect.tokens(copy_.table), 0)[0]
        meta = self._table(name)
        self._allow("INSERT", name)
        kinds = {c["name"]: c["type"] for c in meta["columns"]}
        columns = copy_.columns or list(kinds)
        for c in columns:
            if c not in kinds:
                raise SqlError("42703", f"column {c} of {name} does not exist")
        if copy_.format == "binary":
            rows = copy_format.read_binary(self.spark, path, {c: kinds[c] for c in columns})
        elif copy_.format == "csv":
            rows = copy_format.read_csv(self.spark, path, columns, copy_.delimiter, copy_.null, copy_.header)
        else:
            rows = copy_format.read_text(self.spark, path, columns, copy_.delimiter, copy_.null)
        self._register(rows, "tl_copied")
        quoted = ", ".join(f'"{c}"' for c in columns)
        done = self._insert(dialect.tokens(f"INSERT INTO {copy_.table} ({quoted}) SELECT * FROM tl_copied"))
        return Result("COPY " + done.tag.split()[-1])

    def copy_in(self, text: str, data: bytes | str) -> Result:
        """COPY t FROM STDIN with the client's data, in a transaction of its own outside of BEGIN."""
        folder = f"{self.store.root}/staging/{uuid.uuid4().hex}"
        out = self.store._fs.create(self.store._path(f"{folder}/part"), False)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
        return self.sql(re.sub(r"\bFROM\s+STDIN\b", lambda _: f"FROM '{folder}'", text, flags=re.I))

    def copy_out(self, text: str) -> Iterator[str]:
        """The lines of COPY t or (query) TO STDOUT, as they are computed."""
        folder = f"{self.store.root}/staging/{uuid.uuid4().hex}"
        self.sql(re.sub(r"\bTO\s+STDOUT\b", lambda _: f"TO '{folder}'", text, flags=re.I))
        yield from (r.value for r in self.spark.read.text(folder).toLocalIterator())

    def _cursor(self, t) -> Result:
        """DECLARE c CURSOR FOR query; FETCH or MOVE [n | ALL | NEXT | FORWARD n] FROM c; CLOSE c | ALL."""
        head = word(t, 0)
        if head == "declare":
            if not self.open:
                raise SqlError("25P01", "DECLARE CURSOR needs a transaction")
            self.portals[plain(t[1])] = Portal(self._select(t[find(t, "for") + 1 :]))
            return Result("DECLARE CURSOR")
        if head == "close" and word(t, 1) == "all":
            self.portals.clear()
            return Result("CLOSE CURSOR ALL")
        name = plain(t[-1])
        if name not in self.portals:
            raise SqlError("34000", f"cursor {name} does not exist")
        if head == "close":
            del self.portals[name]
            return Result("CLOSE CURSOR")
        wanted = next((int(x) for kind, x in t[1:-1] if kind == "number"), None)
        most = wanted if wanted is not None else 2**62 if find(t, "all") > 0 else 1
        rows = self.portals[name].fetch(most)
        if head == "move":
            return Result(f"MOVE {len(rows)}")
        return Result(f"FETCH {len(rows)}", self.spark.createDataFrame(rows, self.portals[name].schema))

    def _vacuum(self, t) -> Result:
        """Merge the data folders of a table (of all tables) that INSERTs left, and remove data that no kept version names."""
        self._allow("MAINTAIN", SYSTEM, "database")
        names = [self._name(p, 0)[0] for p in split_top(t[1 + (word(t, 1) == "full") :])] or list(self.state["tables"])
        for name in names:
            if len(self._table(name)["data"]) > 1:
                self._table(name)["data"] = [self.store.write_data(self.frame(name))]
        if not self.open:
            self.store.vacuum()
        return Result("VACUUM")

    def _truncate(self, t) -> Result:
        name, _ = self._name(t, 2 if word(t, 1) == "table" else 1)
        self._allow("DELETE", name)
        self._table(name)["data"] = []
        return Result("TRUNCATE TABLE")

    def _checked(self, name: str, meta: dict, rows: DataFrame, columns: list[str], fresh: bool) -> None:
        """Raise where rows, just written, break a constraint.  fresh: rows come on top of the table; else they are in it."""
        broken = {c["name"]: "23502" for c in meta["columns"] if not c["nullable"]}
        tests = [F.max(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(broken)]
        tests += [F.max(F.expr(f"NOT ({render_all(dialect.tokens(k['sql']))})")).alias(f"c{i}") for i, k in enumerate(meta["checks"])]
        if tests:
            found = rows.agg(*tests).first()
            for i, c in enumerate(broken):
                if found[f"n{i}"]:
                    raise SqlError("23502", f"null value in column {c} of {name}")
            for i, k in enumerate(meta["checks"]):
                if found[f"c{i}"]:
                    raise SqlError("23514", f"new row of {name} violates check {k['name']}")
        for k in meta["keys"]:
            key = k["columns"]
            known = " AND ".join(f"`{c}` IS NOT NULL" for c in key)
            if fresh:
                own = rows.where(known).select(key)
                twice = not own.groupBy(*key).count().where("count > 1").isEmpty() or not own.join(self.frame(name).select(key), key, "left_semi").isEmpty()
            else:
                twice = bool(set(key) & set(columns)) and not self.frame(name).where(known).groupBy(*key).count().where("count > 1").isEmpty()
            if twice:
                raise SqlError("23505", f"duplicate key value violates unique constraint {k['name']}")
        for k in meta["fks"]:
            known = " AND ".join(f"`{c}` IS NOT NULL" for c in k["columns"])
            parent = self.frame(k["table"]).select([F.col(f"`{c}`").alias(o) for c, o in zip(k["refs"], k["columns"])])
            if not rows.where(known).select(k["columns"]).join(parent, k["columns"], "left_anti").isEmpty():
                raise SqlError("23503", f"insert or update on {name} violates foreign key {k['name']}")

    # -- definitions ---------------------------------------------------------------------------------------------

    def _create(self, t) -> Result:
        what = word(t, 1)
        if what == "table":
            return self._create_table(t)
        if what in ("view", "or"):
            at = find(t, "view")
            name, at = self._name(t, at + 1)
            self._allow("CREATE", self._schema_of(name), "schema")
            if name in self.state["tables"]:
                if what != "or":
                    raise SqlError("42P07", f"relation {name} already exists")
                self._allow("DROP", name)
            body = t[find(t, "as", start=at) + 1 :]
            df = self._select(list(body))
            self.state["tables"][name] = {"columns": [{"name": n, "type": k.upper(), "nullable": True, "default": None} for n, k in df.dtypes], "keys": [], "checks": [], "fks": [], "indexes": [], "data": [], "view": " ".join(x for _, x in body), "owner": self.role}
            return Result("CREATE VIEW")
        if what in ("index", "unique"):
            on = find(t, "on")
            name, at = self._name(t, on + 1)
            meta = self._table(name)
            self._allow("INDEX", name)
            at = at if t[at][1] == "(" else at + 2
            columns = [plain(c[0]) for c in split_top(t[at + 1 : matching(t, at)])]
            label = plain(t[on - 1]) if word(t, on - 1) not in ("index", "exists") else f"{name}_{'_'.join(columns)}_idx"
            if what == "unique":
                known = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
                if not self.frame(name).where(known).groupBy(*columns).count().where("count > 1").isEmpty():
                    raise SqlError("23505", f"could not create unique index {label}")
                meta["keys"].append({"name": label, "columns": columns, "primary": False})
            meta["indexes"].append({"name": label, "columns": columns, "unique": what == "unique"})
            return Result("CREATE INDEX")
        if what == "schema":
            name = plain(t[-1])
            self._allow("CREATE", SYSTEM, "database")
            if name in self.state["schemas"] and find(t, "if") < 0:
                raise SqlError("42P06", f"schema {name} already exists")
            self.state["schemas"] = sorted({*self.state["schemas"], name})
            return Result("CREATE SCHEMA")
        if what in ("role", "user"):
            self._allow("GRANT", SYSTEM, "database")
            if plain(t[2]) in self.state["roles"]:
                raise SqlError("42710", f"role {plain(t[2])} already exists")
            self.state["roles"][plain(t[2])] = {"of": [], "login": find(t, "login") > 0 or what == "user"}
            return Result("CREATE ROLE")
        raise SqlError("42601", f"CREATE {what.upper()} is not supported")

    def _create_table(self, t) -> Result:
        at = 2 + 3 * (word(t, 2) == "if")
        name, at = self._name(t, at)
        if "." in name and name.split(".")[0] not in self.state["schemas"]:
            raise SqlError("3F000", f"schema {name.split('.')[0]} does not exist")
        self._allow("CREATE", self._schema_of(name), "schema")
        if name in self.state["tables"]:
            if word(t, 2) == "if":
                return Result("CREATE TABLE")
            raise SqlError("42P07", f"relation {name} already exists")
        meta = {"columns": [], "keys": [], "checks": [], "fks": [], "indexes": [], "data": [], "view": None, "owner": self.role}
        if word(t, at) == "as":
            rows = self._select(t[at + 1 :])
            meta["columns"] = [{"name": n, "type": k.upper(), "nullable": True, "default": None} for n, k in rows.dtypes]
            meta["data"] = [self.store.write_data(rows)]
        else:
            for part in split_top(t[at + 1 : matching(t, at)]):
                self._define(name, meta, part)
        self.state["tables"][name] = meta
        return Result("CREATE TABLE")

    def _define(self, name: str, meta: dict, part) -> None:
        """One element of a table's definition: a column with its constraints, or a table constraint."""
        label = None
        if word(part, 0) == "constraint":
            label, part = plain(part[1]), part[2:]
        head = word(part, 0)
        if head in ("primary", "unique", "check", "foreign"):
            self._constraint(name, meta, part, None, label)
            return
        stops = ("primary", "unique", "check", "references", "not", "null", "default", "constraint")
        starts = [i for i in range(1, len(part)) if word(part, i) in stops and not (word(part, i) == "null" and word(part, i - 1) in ("not", "default")) and not self._inside(part, i)]
        cuts = [*starts, len(part)]
        column = {"name": plain(part[0]), "type": column_type(part[1 : cuts[0]]), "nullable": True, "default": None}
        meta["columns"].append(column)
        for a, b in zip(cuts, cuts[1:]):
            piece = part[a:b]
            if word(piece, 0) == "constraint":
                label = plain(piece[1])
            elif word(piece, 0) == "not":
                column["nullable"] = False
            elif word(piece, 0) == "default":
                column["default"] = " ".join(x for _, x in piece[1:])
            elif word(piece, 0) != "null":
                self._constraint(name, meta, piece, column["name"], label)
                label = None

    @staticmethod
    def _inside(t, at: int) -> bool:
        depth = 0
        for _, x in t[:at]:
            depth += x in ("(", "[")
            depth -= x in (")", "]")
        return depth > 0

    def _constraint(self, name: str, meta: dict, t, column: str | None, label: str | None) -> None:
        head = word(t, 0)
        bracket = next((i for i, (_, x) in enumerate(t) if x == "("), -1)
        listed = [plain(c[0]) for c in split_top(t[bracket + 1 : matching(t, bracket)])] if bracket >= 0 and head != "check" else []
        if head in ("primary", "unique"):
            columns = [column] if column else listed
            meta["keys"].append({"name": label or (f"{name}_pkey" if head == "primary" else f"{name}_{'_'.join(columns)}_key"), "columns": columns, "primary": head == "primary"})
            for c in meta["columns"]:
                if head == "primary" and c["name"] in columns:
                    c["nullable"] = False
        elif head == "check":
            meta["checks"].append({"name": label or f"{name}_check{len(meta['checks']) or ''}", "sql": " ".join(x for _, x in t[bracket + 1 : matching(t, bracket)])})
        else:
            at = find(t, "references")
            parent, end = self._name(t, at + 1)
            refs = [plain(c[0]) for c in split_top(t[end + 1 : matching(t, end)])] if end < len(t) and t[end][1] == "(" else next(k["columns"] for k in self._table(parent)["keys"] if k["primary"])
            columns = [column] if column else listed
            meta["fks"].append({"name": label or f"{name}_{'_'.join(columns)}_fkey", "columns": columns, "table": parent, "refs": refs})

    def _drop(self, t) -> Result:
        what, quiet = word(t, 1), find(t, "exists") > 0
        names = [self._name(p, 0)[0] for p in split_top([x for x in t[2 + 2 * quiet :] if x[1].lower() not in ("cascade", "restrict")])]
        for name in names:
            if what in ("table", "view"):
                meta = self.state["tables"].get(name)
                if meta is None or bool(meta["view"]) != (what == "view"):
                    if quiet:
                        continue
                    raise SqlError("42P01", f"{what} {name} does not exist")
                self._allow("DROP", name)
                del self.state["tables"][name]
            elif what == "schema":
                self._allow("DROP", SYSTEM, "database")
                if name not in self.state["schemas"] and not quiet:
                    raise SqlError("3F000", f"schema {name} does not exist")
                if any(k.startswith(f"{name}.") for k in self.state["tables"]) and find(t, "cascade") < 0:
                    raise SqlError("2BP01", f"schema {name} is not empty")
                self.state["schemas"] = [s for s in self.state["schemas"] if s != name]
                self.state["tables"] = {k: v for k, v in self.state["tables"].items() if not k.startswith(f"{name}.")}
            elif what == "index":
                tables_ = [k for k, m in self.state["tables"].items() if any(i["name"] == name for i in m["indexes"])]
                for k in tables_:
                    self._allow("INDEX", k)
                found = [self.state["tables"][k] for k in tables_]
                if not found and not quiet:
                    raise SqlError("42704", f"index {name} does not exist")
                for m in found:
                    m["indexes"] = [i for i in m["indexes"] if i["name"] != name]
                    m["keys"] = [k for k in m["keys"] if k["name"] != name]
            elif what in ("role", "user"):
                self._allow("GRANT", SYSTEM, "database")
                if self.state["roles"].pop(name, None) is None and not quiet:
                    raise SqlError("42704", f"role {name} does not exist")
                self.state["grants"] = [g for g in self.state["grants"] if g[2] != name]
            else:
                raise SqlError("42601", f"DROP {what.upper()} is not supported")
        return Result(f"DROP {what.upper()}")

    def _alter(self, t) -> Result:
        if word(t, 1) != "table":
            raise SqlError("42601", "only ALTER TABLE is supported")
        name, at = self._name(t, 2 + (word(t, 2) == "only"))
        self._table(name)
        self._allow("ALTER", name)
        for part in split_top(t[at:]):
            self._alter_one(name, self._table(name), part)
            if word(part, 0) == "rename" and word(part, 1) == "to":
                name = plain(part[2])
        return Result("ALTER TABLE")

    def _rewrite(self, meta: dict, name: str, expressions: list[str]) -> None:
        if meta["data"]:
            meta["data"] = [self.store.write_data(self.frame(name).selectExpr(*expressions))]

    def _alter_one(self, name: str, meta: dict, t) -> None:
        head, columns = word(t, 0), [c["name"] for c in meta["columns"]]
        skip = 1 + (word(t, 1) == "column")
        if head == "add" and word(t, 1) in ("constraint", "primary", "unique", "check", "foreign"):
            self._define(name, meta, t[1:])
            self._checked(name, meta, self.frame(name), columns, fresh=False)
        elif head == "add":
            old = [f"`{c}`" for c in columns]
            fresh = copy.deepcopy(meta)
            self._define(name, fresh, t[skip:])
            c = fresh["columns"][-1]
            self._rewrite(meta, name, [*old, f"{coerced(render_all(dialect.tokens(c['default'] or 'NULL')), c['type'])} AS `{c['name']}`"])
            fresh["data"] = meta["data"]
            self.state["tables"][name] = fresh
            self._checked(name, fresh, self.frame(name), [c["name"]], fresh=False)
        elif head == "drop" and word(t, 1) == "constraint":
            for part in ("keys", "checks", "fks"):
                meta[part] = [k for k in meta[part] if k["name"] != plain(t[2])]
        elif head == "drop":
            gone = plain(t[skip])
            if gone not in columns:
                raise SqlError("42703", f"column {gone} does not exist")
            self._rewrite(meta, name, [f"`{c}`" for c in columns if c != gone])
            meta["columns"] = [c for c in meta["columns"] if c["name"] != gone]
            for part in ("keys", "fks", "indexes"):
                meta[part] = [k for k in meta[part] if gone not in k["columns"]]
        elif head == "rename" and word(t, 1) == "to":
            self.state["tables"][plain(t[2])] = self.state["tables"].pop(name)
        elif head == "rename":
            old, new = plain(t[skip]), plain(t[skip + 2])
            self._rewrite(meta, name, [f"`{c}` AS `{new if c == old else c}`" for c in columns])
            for c in meta["columns"]:
                c["name"] = new if c["name"] == old else c["name"]
            for part in ("keys", "fks", "indexes"):
                for k in meta[part]:
                    k["columns"] = [new if c == old else c for c in k["columns"]]
        elif head == "alter":
            column = next(c for c in meta["columns"] if c["name"] == plain(t[skip]))
            rest = t[skip + 1 :]
            if find(rest, "type") >= 0:
                kind = column_type(rest[find(rest, "type") + 1 :])
                self._rewrite(meta, name, [f"{coerced('`' + c + '`', kind)} AS `{c}`" if c == column["name"] else f"`{c}`" for c in columns])
                column["type"] = kind
            elif find(rest, "default") >= 0:
                column["default"] = " ".join(x for _, x in rest[2:]) if word(rest, 0) == "set" else None
            else:
                column["nullable"] = word(rest, 0) == "drop"
                self._checked(name, meta, self.frame(name), [], fresh=False)
        else:
            raise SqlError("42601", "this ALTER TABLE is not supported")

    # -- roles and settings --------------------------------------------------------------------------------------

    def _grant(self, t) -> Result:
        """GRANT or REVOKE rights ON [TABLE] t, SCHEMA s or SYSTEM, or the membership of a role; who owns a table or was given GRANT on it may."""
        head, on = word(t, 0), find(t, "on")
        to = find(t, "to") if head == "grant" else find(t, "from")
        takers = [plain(p[0]) for p in split_top(t[to + 1 :])]
        if on < 0:
            self._allow("GRANT", SYSTEM, "database")
            for group in (plain(p[0]) for p in split_top(t[1:to])):
                for taker in takers:
                    for r in (group, taker):
                        if r not in self.state["roles"]:
                            raise SqlError("42704", f"role {r} does not exist")
                    of = [r for r in self.state["roles"][taker].get("of", []) if r != group]
                    self.state["roles"][taker]["of"] = of + [group] * (head == "grant")
            return Result(head.upper() + " ROLE")
        actions = [("ALL" if word(p, 0) == "all" else word(p, 0).upper()) for p in split_top(t[1:on])]
        what = word(t, on + 1) if word(t, on + 1) in ("table", "schema", "system", "database") else ""
        if what in ("system", "database"):
            names = [SYSTEM]
            self._allow("GRANT", SYSTEM, "database")
        else:
            names = [self._name(p, 0)[0] for p in split_top(t[on + 1 + bool(what) : to])]
            for n in names:
                if what == "schema" and n not in self.state["schemas"]:
                    raise SqlError("3F000", f"schema {n} does not exist")
                if what != "schema":
                    self._table(n)
                self._allow("GRANT", n, "schema" if what == "schema" else "table")
        rules = [[a, n, r] for a in actions for n in names for r in takers]
        kept = [g for g in self.state["grants"] if g not in rules and not (head == "revoke" and "ALL" in actions and g[1] in names and g[2] in takers)]
        self.state["grants"] = kept + (rules if head == "grant" else [])
        return Result(head.upper())

    def _set(self, t) -> Result:
        if word(t, 1) == "time":
            name, value = "timezone", t[3:]
        else:
            skip = 1 + (word(t, 1) in ("session", "local"))
            name, value = plain(t[skip]), t[skip + 2 :]
        self.settings[name] = ", ".join(dialect.literal(x) if k == "text" else x for k, x in value if x != ",")
        return Result("SET")

    def _show(self, t) -> Result:
        name = "timezone" if word(t, 1) == "time" else plain(t[1])
        if name == "all":
            return Result("SHOW", self.spark.createDataFrame(sorted(self.settings.items()), "name string, setting string"))
        if name not in self.settings:
            raise SqlError("42704", f"unrecognized configuration parameter {name}")
        return Result("SHOW", self.spark.createDataFrame([(self.settings[name],)], f"`{name}` string"))

    def _discard(self, t) -> Result:
        if word(t, 0) == "discard":
            self.settings = dict(SETTINGS)
        return Result(word(t, 0).upper() + (" ALL" if word(t, 0) == "discard" else ""))
