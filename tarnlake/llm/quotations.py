"""Chat formatting by quotation linking (DataFrame functions only).

Lines are parsed into quote levels ("> > text"); runs of lines of one level are passages.  The hash of each quoted passage,
and of each of its lines, is joined to the passages and lines that earlier messages of the conversation wrote themselves.  A
message replies to the message it quotes; following replies gives its thread and depth, and the messages come back
without quotes in reply order.

The join is an as-of join: the latest earlier turn with the hash.  It runs over slices of SLICE turns, and the last turn of
each slice is carried to the later ones, so neither a very common line nor a very long conversation gathers in one task
or makes pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_columns, written

SLICE = 1024
MARK = r"^[ \t]*(>[ \t]*)+"
WROTE = r"(?i)^[ \t]*(on .* wrote|am .* schrieb .*|le .* a écrit|el .* escribió)[ \t]*:[ \t]*$"


def parsed_lines(text: Column) -> Column:
    """[(level, body)] of the lines; a body has neither quote marks nor white space around it."""
    mark = lambda line: F.regexp_extract(line, MARK, 0)
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(F.length(F.regexp_replace(mark(line), "[^>]", "")).alias("level"), F.regexp_replace(F.regexp_replace(line, MARK, ""), r"^\s+|\s+$", "").alias("body")),
    )


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passages(lines: Column) -> Column:
    """[(level, [bodies])]: runs of lines of one level that are not blank."""
    changes = lambda i: (
        (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]) | ((F.get(lines, i)["body"] == "") != (F.get(lines, i - 1)["body"] == ""))
    )
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), changes)
    runs = F.transform(
        starts,
        lambda s, j: F.struct(
            F.get(lines, s)["level"].alias("level"),
            F.transform(F.slice(lines, s + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - s), lambda x: x["body"]).alias("bodies"),
        ),
    )
    return F.filter(runs, lambda r: F.get(r["bodies"], F.lit(0)) != "")


def anchors(runs: Column) -> Column:
    """[(level, grain, hash)]: each passage (grain 2) and, where it has several lines, each of those (grain 1)."""
    hashed = lambda x: F.md5(normalised(x).cast("binary"))
    each = F.transform(
        runs,
        lambda r: F.concat(
            F.array(F.struct(r["level"].alias("level"), F.lit(2).alias("grain"), hashed(F.array_join(r["bodies"], " ")).alias("hash"))),
            F.when(
                F.size(r["bodies"]) > 1,
                F.transform(r["bodies"], lambda b: F.struct(r["level"].alias("level"), F.lit(1).alias("grain"), hashed(b).alias("hash"))),
            ).otherwise(F.array().cast("array<struct<level:int,grain:int,hash:string>>")),
        ),
    )
    return F.array_distinct(F.flatten(each))


def unquoted(lines: Column) -> Column:
    """The lines of level 0, without the "... wrote:" line before a quote, trimmed."""
    own = lambda x, i: (x["level"] == 0) & ~(F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)).__gt__(0) & x["body"].rlike(WROTE))
    return F.regexp_replace(F.array_join(F.transform(F.filter(lines, own), lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def latest_before(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted (conv, turn, hash, ...) with ``target``: the latest turn before its own at which own (conv, turn, hash) has the
    hash, rows without one left out."""
    key = ["conv", "hash", "slice"]
    sliced = lambda df: df.withColumn("slice", F.floor(F.col("turn") / SLICE))
    own = sliced(own)
    # only hashes that are quoted in the conversation take part
    own = own.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    both = own.select(*key, "turn", F.col("turn").alias("mine"), F.lit(None).cast("array<struct<level:int,grain:int>>").alias("uses")).unionByName(
        sliced(quoted.groupBy("conv", "hash", "turn").agg(F.collect_set(F.struct("level", "grain")).alias("uses"))).select(*key, "turn", F.lit(None).cast("bigint").alias("mine"), "uses")
    )
    inside = Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("mine").over(inside)).where("uses is not null")
    lasts = own.groupBy(*key).agg(F.max("turn").alias("last"))
    wanted = near.where("near is null").select(*key).distinct().withColumn("last", F.lit(None).cast("bigint"))
    carried = lasts.unionByName(wanted).groupBy(*key).agg(F.max("last").alias("last"))
    before = carried.withColumn("carried", F.max("last").over(Window.partitionBy("conv", "hash").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    found = near.join(before.select(*key, "carried"), key, "left").withColumn("target", F.coalesce("near", "carried"))
    return found.where("target is not null").select("conv", "turn", "target", F.explode("uses").alias("use")).select("conv", "turn", "target", "use.level", "use.grain")


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, parent) -> (conv, turn, thread, depth) by pointer doubling; replies go to earlier turns."""
    state = written(replies.select("conv", "turn", F.col("parent").alias("thread"), F.lit(1).cast("bigint").alias("depth")), "replies")
    while True:
        up = state.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        joined = state.join(up, ["conv", "thread"], "left")
        moved = written(joined.select("conv", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "doubled")
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row, in the order conv_id, thread, depth, turn: conv_id, turn, role, text (without quotes), quotes (the
    passages it quoted), reply_to (the turn it replies to, null if none), thread (the turn its thread begins with), depth.

    Of several quoted messages a reply's is the one of the outermost quote, then whole passages before lines, then most
    anchors, then the latest.  A null text stays null and quotes nothing; a null conv_id or turn links to nothing and
    is its own thread (thread is then its turn).  Rows of one conv_id and turn are one message: each keeps its row and text, what
    one of them quotes holds for all.  Very long texts are parsed whole; an empty table gives no rows.
    """
    raw = own_columns(messages, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    raw = raw.select(F.col("conv").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    rows = raw.select("*", parsed_lines(F.col("text")).alias("lines")).select("conv", "turn", "text", passages(F.col("lines")).alias("runs"))
    usable = rows.where("conv is not null and turn is not null and text is not null").select("conv", "turn", F.explode(anchors(F.col("runs"))).alias("a")).select("conv", "turn", "a.level", "a.grain", F.unhex("a.hash").alias("hash"))
    usable = written(usable, "anchors")  # texts are parsed here and for the output, and nowhere else
    quoted = usable.where("level > 0")
    own = usable.where("level = 0").select("conv", "turn", "hash").distinct()
    linked = latest_before(own, quoted)
    ranked = linked.groupBy("conv", "turn", "target").agg(F.min("level").alias("level"), F.max("grain").alias("grain"), F.count(F.lit(1)).alias("n"))
    replies = ranked.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "grain", "n", "target"))["target"].alias("parent"))
    replies = written(replies, "parents")
    placed = threads(replies).join(replies, ["conv", "turn"]).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "thread", "depth")
    ordered = raw.join(placed, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "text",
        F.col("parent").alias("reply_to"),
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
    )
    # parsed once they are in order: a sort by range reads its input twice
    lined = ordered.orderBy("conv_id", "thread", "depth", "turn").select("*", parsed_lines(F.col("text")).alias("lines"))
    return lined.select("*", unquoted(F.col("lines")).alias("clean"), passages(F.col("lines")).alias("runs")).select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("text").isNotNull(), F.col("clean")).alias("text"),
        F.coalesce(F.size(F.filter("runs", lambda r: r["level"] > 0)), F.lit(0)).cast("bigint").alias("quotes"),
        "reply_to",
        "thread",
        "depth",
    )


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id AS conv, turn, role, text FROM conversations),
l AS (
  SELECT r, conv, turn, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS s FROM m WHERE text IS NOT NULL)
), p AS (
  SELECT r, conv, turn, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+', 0), '[^>]', '', 'g')) AS level,
    regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '^\s+|\s+$', '', 'g') AS body
  FROM l
), k AS (
  SELECT *, sum(CASE WHEN i = 1 OR level <> before OR (body = '') <> (last = '') THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT *, lag(level) OVER w AS before, lag(body) OVER w AS last, lead(level) OVER w AS after FROM p WINDOW w AS (PARTITION BY r ORDER BY i))
), runs AS (
  SELECT r, conv, turn, run, min(level) AS level, string_agg(body, ' ' ORDER BY i) AS whole, list(body ORDER BY i) AS bodies FROM k WHERE body <> '' GROUP BY ALL
), a AS (
  SELECT DISTINCT r, conv, turn, level, 2 AS grain, md5(lower(trim(regexp_replace(whole, '\s+', ' ', 'g')))) AS hash FROM runs
  UNION SELECT DISTINCT r, conv, turn, level, 1, md5(lower(trim(regexp_replace(unnest(bodies), '\s+', ' ', 'g')))) FROM runs WHERE len(bodies) > 1
), own AS (SELECT DISTINCT conv, turn, hash FROM a WHERE level = 0),
hit AS (
  SELECT q.conv, q.turn, q.level, q.grain, max(o.turn) AS target FROM (SELECT DISTINCT conv, turn, level, grain, hash FROM a WHERE level > 0) q
  JOIN own o ON o.conv = q.conv AND o.hash = q.hash AND o.turn < q.turn GROUP BY q.conv, q.turn, q.level, q.grain, q.hash
), ranked AS (
  SELECT conv, turn, target, row_number() OVER (PARTITION BY conv, turn ORDER BY min(level), max(grain) DESC, count(*) DESC, target DESC) AS n FROM hit GROUP BY conv, turn, target
), replies AS (SELECT conv, turn, target AS parent FROM ranked WHERE n = 1),
up AS (
  SELECT conv, turn, parent AS thread, 1 AS depth FROM replies
  UNION ALL SELECT u.conv, u.turn, x.parent, u.depth + 1 FROM up u JOIN replies x ON x.conv = u.conv AND x.turn = u.thread
), top AS (SELECT conv, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY conv, turn),
clean AS (
  SELECT r, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS text FROM k
  WHERE level = 0 AND NOT (coalesce(after, 0) > 0 AND regexp_matches(body, '(?i)^[ \t]*(on .* wrote|am .* schrieb .*|le .* a écrit|el .* escribió)[ \t]*:[ \t]*$')) GROUP BY r
), quotes AS (SELECT r, count(*) AS quotes FROM runs WHERE level > 0 GROUP BY r)
SELECT m.conv AS conv_id, m.turn, m.role, CASE WHEN m.text IS NOT NULL THEN coalesce(c.text, '') END AS text, coalesce(q.quotes, 0) AS quotes,
  y.parent AS reply_to, coalesce(t.thread, m.turn) AS thread, coalesce(t.depth, 0)::BIGINT AS depth
FROM m LEFT JOIN clean c USING (r) LEFT JOIN quotes q USING (r)
LEFT JOIN replies y ON y.conv = m.conv AND y.turn = m.turn LEFT JOIN top t ON t.conv = m.conv AND t.turn = m.turn
"""
