"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each document is repeated k times, k drawn from a Poisson distribution whose mean is its source's target repetition
rate: the draw inverts the distribution function at a uniform number hashed from seed and document.  The repeats are
exploded and shuffled globally by a hash of (seed, document, repeat).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, uniform

#: A Poisson of a larger mean is a sum of independent ones of at most this mean; SPAN terms of one leave less than 2**-60.
CHUNK_MEAN, SPAN = 8.0, 64
#: Beyond so many sources their rates are not broadcast but joined on (source, salt).
BROADCAST_SOURCES, SALTS = 10_000, 64


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. SPAN - 1 as an array, mean at most CHUNK_MEAN."""
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        (acc["c"] + acc["p"] * mean / k).alias("c"),
        F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all"),
    )
    first = F.exp(-mean)
    zero = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SPAN - 1)), zero, step)["all"]


def rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float, source_col: str) -> DataFrame:
    """A row a source: source, rows, rate (its mean repetitions), chunks, cdf (of one chunk).

    The weights of the sources present are scaled to sum 1 and the mix is aimed at epochs * all rows."""
    if any(not (w >= 0 and math.isfinite(w)) for w in [*weights.values(), other]):
        raise ValueError("weights are finite and not negative")
    stated = F.lit(float(other))
    for name, weight in sorted(weights.items()):
        stated = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(stated)
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows")).withColumn("weight", stated)
    total = counts.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weights"))  # one row
    rated = counts.join(F.broadcast(total)).select(
        "source", "rows", F.when(F.col("all_weights") > 0, F.col("weight") / F.col("all_weights") * F.col("all_rows") * F.lit(float(epochs)) / F.col("rows")).otherwise(F.lit(0.0)).alias("rate")
    )
    rated = rated.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(CHUNK_MEAN))).cast("int"))
    return rated.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("chunks")))


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    other: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with each row repeated to its source's rate, plus ``copy`` (from 0) and ``shuffle_key``, in the order of that key.

    A source that weights doesn't name, null among them, has the weight ``other``.  A row whose draw is 0 is left out: that
    is the sampling.  Rows of one id (a null id too) share a draw, repeated rows each get it; ids differ, so draws are
    independent.  Empty and very long texts count as one row like any other.  An empty table gives no rows.  Columns of docs
    named copy or shuffle_key raise ValueError.
    """
    if clash := {"copy", "shuffle_key"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    names = docs.columns
    rows = numbered(docs).withColumn("id", F.col(f"c{names.index(id_col)}")).withColumn("source", F.coalesce(F.col(f"c{names.index(source_col)}").cast("string"), F.lit("\u0000")))
    own = [f"c{i}" for i in range(len(names))]
    rated = rates(docs, weights, other, epochs, source_col).select(F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("source"), "chunks", "cdf")
    if docs.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rated), "source", "left")
    else:
        salted = rated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"], "left")
    draw = lambda i: F.size(F.filter(F.col("cdf"), lambda c: c <= uniform("id", i, seed=seed)))
    count = F.when(F.col("chunks") == 1, F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("chunks")), F.lit(0), lambda acc, i: acc + draw(i))
    )
    repeated = joined.withColumn("u", uniform("id", F.lit(1), seed=seed)).withColumn("n", count).where("n > 0")
    repeated = repeated.select(*own, "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    hashed = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:shuffle"), F.coalesce(F.col("id").cast("string"), F.lit("\u0000")), F.col("copy").cast("string")).cast("binary")), 1, 15)
    keyed = repeated.select(*own, "copy", F.conv(hashed, 16, 10).cast("bigint").alias("shuffle_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftrightunsigned(F.col("shuffle_key"), 30) * parts
    shuffled = keyed.repartitionById(parts, F.shiftrightunsigned(part, 30).cast("int")).sortWithinPartitions("shuffle_key")
    return shuffled.toDF(*names, "copy", "shuffle_key")


#: Production parameters: src0, which holds a third of the rows, is thinned; three small sources are repeated.
WEIGHTS, OTHER, EPOCHS, SEED = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}, 1.0, 1.0, 17

ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, chr(1)) AS s, count(*) AS n,
    CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 2.0::DOUBLE WHEN 'src3' THEN 0.5::DOUBLE ELSE {OTHER}::DOUBLE END AS w
  FROM documents GROUP BY source
), rated AS (
  SELECT s, w / (SELECT sum(w) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE * {EPOCHS}::DOUBLE / n::DOUBLE AS rate FROM counts
), chunked AS (
  SELECT s, greatest(1, ceil(rate / 8.0))::INT AS chunks, rate / greatest(1, ceil(rate / 8.0))::INT AS mean FROM rated
), cdf AS (
  SELECT s, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM chunked
  UNION ALL
  SELECT s, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {SPAN - 1}
), listed AS (
  SELECT s, list(c ORDER BY k) AS cs FROM cdf GROUP BY s
), drawn AS (
  SELECT d.*, list_sum([len(list_filter(l.cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) for i in range(1, ch.chunks + 1)])::INT AS n
  FROM documents d JOIN listed l ON l.s = coalesce(d.source, chr(1)) JOIN chunked ch ON ch.s = l.s
), repeated AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INT AS copy FROM drawn
)
SELECT *, ('0x' || substr(md5('{SEED}:shuffle:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key FROM repeated
"""
