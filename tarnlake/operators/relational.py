"""Relational operators that Spark SQL has no syntax for, composed of DataFrame operations."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ROUNDS = 10_000
#: Rows of a key on either side that full_join puts into a block, and rows it gives a task.
BLOCK_ROWS = 1_000
TASK_ROWS = 2_000_000
#: Keys up to which full_join broadcasts how they are dealt.
BROADCAST_KEYS = 100_000


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (SELECT DISTINCT ON)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def groups_frame(df: DataFrame, keys: list[str], order: list[str], aggregate: Column, name: str, low: int, high: int) -> DataFrame:
    """aggregate over the frame GROUPS BETWEEN low AND high: peers are numbered, and the frame is a range of numbers."""
    numbered = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.withColumn(name, aggregate.over(Window.partitionBy(*keys).orderBy("__peer").rangeBetween(low, high))).drop("__peer")


def with_ordinality(df: DataFrame, array: Column, value: str = "value", ordinal: str = "ordinality", outer: bool = False) -> DataFrame:
    """df joined to the elements of an array, numbered from 1; outer keeps rows without elements."""
    explode = F.posexplode_outer if outer else F.posexplode
    exploded = df.select("*", explode(array).alias("__at", value))
    return exploded.withColumn(ordinal, (F.col("__at") + 1).cast("bigint")).drop("__at")


def full_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """left FULL JOIN right on equal keys, where a key may have very many rows on both sides; no column name is on both.

    Rows of a key are dealt into blocks by their hash, and each block of one side meets each of the other in a task that it finds by
    key and blocks, so a frequent key is shared by all tasks.  What moves is a small part of the result: a row goes once to each
    block of the other side.  Rows whose key the other side lacks, null keys among them, follow from the matched keys.
    """
    names = [f"tl_k{i}" for i in range(len(left_keys))]

    def counted(df: DataFrame, keys: list[str], n: str) -> DataFrame:
        return df.groupBy(*[F.col(f"`{k}`").alias(c) for k, c in zip(keys, names)]).agg(F.count(F.lit(1)).alias(n))

    matched = checkpointed(counted(left, left_keys, "tl_left").join(counted(right, right_keys, "tl_right"), names))
    n, made = matched.agg(F.count(F.lit(1)), F.sum(F.expr("tl_left * CAST(tl_right AS DOUBLE) + tl_left + tl_right"))).first()
    dealt = matched.select(*names, *[F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(c) for c in ("tl_left", "tl_right")])
    dealt = F.broadcast(dealt) if n <= BROADCAST_KEYS else dealt
    tasks = max(1, min(100_000, int((made or 0) / TASK_ROWS) + 1))

    def same(df: DataFrame, keys: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [df[f"`{k}`"] == dealt[c] for k, c in zip(keys, names)])

    def blocks(df: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
        at = df.join(dealt, same(df, keys)).withColumns({own: F.pmod(F.xxhash64(*[df[f"`{c}`"] for c in df.columns]), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return at.repartition(tasks, *names, "tl_left", "tl_right")  # a number of tasks of its own: the rows that move are few, those made many

    pairs = blocks(left, left_keys, "tl_left", "tl_right").join(blocks(right, right_keys, "tl_right", "tl_left"), [*names, "tl_left", "tl_right"])
    out = pairs.select(*left.columns, *right.columns)
    for df, keys in ((left, left_keys), (right, right_keys)):
        out = out.unionByName(df.join(dealt, same(df, keys), "left_anti"), allowMissingColumns=True)
    return out


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows reachable from seed, each once; cycles end.

    Semi-naive: a round takes the rows the last one found, and keeps what is new by a null-safe anti-join.  Each round is
    checkpointed in the shared folder, so lineage stays short and a lost executor costs a reread.
    """
    columns = seed.columns
    new = checkpointed(seed.distinct())
    found = new
    for _ in range(MAX_ROUNDS):
        grown = step(new).toDF(*columns).distinct().alias("g")
        same = F.lit(True)
        for c in columns:
            same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}"))
        new = checkpointed(grown.join(found.alias("f"), same, "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    raise RuntimeError(f"recursion exceeded {MAX_ROUNDS} rounds")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.  Only a local session may leave it unset and gets a folder of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tarnlake-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
