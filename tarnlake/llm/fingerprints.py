"""Bottom-k sketches of word shingles.

A sketch is the k least distinct shingle hashes of a text, in ascending order.  Sketches merge (``merge``: the least k of
the union), so parts of a text or of a corpus can be sketched apart; they estimate the number of distinct shingles,
resemblance and containment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

K, WORDS = 128, 5
#: Hashes keep 40 bits: ten hex digits each in the printed form.
BITS = 40


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order.  Words are lower-cased and split at white space; a text of
    fewer words than a shingle is one shingle, one without words has none."""
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.array([digest(w) for w in parts], np.uint64)
    n = max(1, len(each) - words + 1)
    mixed = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(min(words, len(each))):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed >> np.uint64(64 - BITS))


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return shingle_hashes(text, words)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what the sketches stand for."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles: exact below k of them."""
    return float(len(s)) if len(s) < k else (k - 1) * float(1 << BITS) / (float(s[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard likeness; two empty sketches are alike (1), an empty and another are not (0)."""
    both = merge(a, b, k=k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated part of a's shingles that b has; an empty a is contained in anything."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k=k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def printed(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex() if BITS == 64 else "".join([f"{x:010x}" for x in s.tolist()])


def parsed(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + 10], 16) for i in range(0, len(fingerprint), 10)], np.uint64)


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained double"


def _bucket_batches(splits: list[int]):
    """splits ascending; bucket 0 has the largest ids, nulls are in the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splits, np.int64)
        for batch in batches:
            ids = batch.column(0)
            known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            bucket = len(splits) - np.searchsorted(cuts, known, side="left")
            bucket[np.asarray(ids.is_null())] = len(splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32))], [*batch.schema.names, "bucket"])

    return run


def _neighbour_batches(k: int, words: int):
    """Rows come in order, a bucket's own rows first and then the first rows of the next bucket (tail = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, sketch of the last own row
        out: list = []

        def emit(row, text: str, its: np.ndarray) -> None:
            _, i, own, mine = row
            new = edited(own, text)
            other = mine if new == own else sketch(new, k, words)
            out.append((i, len(own), hashlib.sha256(new.encode()).hexdigest(), printed(mine), printed(other), resemblance(mine, other, k), resemblance(mine, its, k), distinct(mine, k), containment(mine, other, k)))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in _OUT.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for bucket, tail, i, text in zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                if tail and (held is None or held[0] != bucket):
                    continue  # a second first row: the tie went before it
                text = text.as_py() or ""
                its = sketch(text, k, words)
                if held is not None:
                    emit(held, text, its)
                held = None if tail else (bucket, i, text, its)
                if len(out) >= 1024:
                    yield flush()
        if out:
            yield flush()

    return run


def fingerprint_neighbours(docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_distinct (estimated distinct shingles), contained (the part of the text's shingles that its edited text has).

    Rows are in the order of descending id, null ids last, ties by text (null as empty); the row after the last is the first, so a
    table of one row is its own next.  A null text is empty.  Two texts without words have likeness 1, one without and one with
    words 0.  An empty table gives no rows.

    The order is dealt by range: ids alone are cut into as many buckets as there are shuffle partitions, the first row
    of each bucket also goes to the bucket before it, and each text is moved once.
    """
    spark = docs.sparkSession
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    found = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    splits = sorted(set(found or []))
    bucketed = rows.mapInArrow(_bucket_batches(splits), "id bigint, text string, bucket int")
    ids = rows.select("id").mapInArrow(_bucket_batches(splits), "id bigint, bucket int")
    heads = sorted(ids.groupBy("bucket").agg(F.max("id").alias("id")).collect())  # a row a bucket
    if not heads:
        return spark.createDataFrame([], _OUT)
    before = {bucket: heads[i - 1][0] for i, (bucket, _) in enumerate(heads)}
    first = spark.createDataFrame([(b, i, before[b]) for b, i in heads], "bucket int, head bigint, goes int")
    joined = bucketed.join(F.broadcast(first), "bucket")
    place = lambda bucket, tail: F.struct(F.col(bucket).alias("b"), F.lit(tail).alias("tail"))
    places = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(place("bucket", 0), place("goes", 1))).otherwise(F.array(place("bucket", 0)))
    placed = joined.select("id", "text", F.explode(places).alias("p")).select("id", "text", F.col("p.b").alias("bucket"), F.col("p.tail").alias("tail"))
    ordered = placed.repartitionById(len(splits) + 1, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("id").desc_nulls_last(), F.coalesce("text", F.lit("")))
    return ordered.mapInArrow(_neighbour_batches(k, words), _OUT)
