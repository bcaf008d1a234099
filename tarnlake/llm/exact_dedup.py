"""Exact dedup with a cuckoo-filter index over live digests.

``CuckooIndex`` keeps 16-bit fingerprints in buckets of four; each slot owns the full digest it stands for, so a
fingerprint hit is verified against bucketed content, a digest can be deleted again, and an overflow (a kick chain
that is too long) doubles the table from the stored keys.

``exact_dedup`` runs the index twice: on the scan, where each task folds its own copies into one entry a digest, and
after one shuffle of those entries by digest.  What moves is a digest, an id and a count: a group of copies that
holds a third of the table sends one entry a scan task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, own_columns, written

SLOTS = 4
MAX_KICKS = 200
#: Live digests of one index: a scan hands its index on at so many, and the shuffle has tasks enough for about so many each.
LIVE_DIGESTS = 500_000
#: drop_copies: up to so many dropped rows (id, and digest where ids repeat) are broadcast.
BROADCAST_ROWS = 1_000_000


class CuckooIndex:
    """A set of live digests (bytes, at least 8 long and evenly spread) with a payload each."""

    def __init__(self, buckets: int = 256) -> None:
        self._alloc(max(1, 1 << (buckets - 1).bit_length()))

    def _alloc(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        tag = (h & 0xFFFF) or 1
        first = (h >> 16) & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995 >> 8) & self.mask)

    def _slot(self, digest: bytes) -> int:
        tag, first, second = self._places(digest)
        tags, keys = self.tags, self.keys
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if tags[slot] == tag and keys[slot] == digest:  # the filter's hit, then the content's word
                    return slot
        return -1

    def __len__(self) -> int:
        return self.live

    def __contains__(self, digest: bytes) -> bool:
        return self._slot(digest) >= 0

    def get(self, digest: bytes):
        slot = self._slot(digest)
        return self.values[slot] if slot >= 0 else None

    def put(self, digest: bytes, value) -> bool:
        """Insert or replace; True if the digest was new."""
        slot = self._slot(digest)
        if slot >= 0:
            self.values[slot] = value
            return False
        self._insert(digest, value)
        return True

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.tags[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)

    def _insert(self, digest: bytes, value) -> None:
        while True:
            tag, first, second = self._places(digest)
            for bucket in (first, second):
                for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if not self.tags[slot]:
                        self.tags[slot], self.keys[slot], self.values[slot] = tag, digest, value
                        self.live += 1
                        return
            bucket = second
            for kick in range(MAX_KICKS):
                slot = bucket * SLOTS + (kick + tag) % SLOTS
                tag, self.tags[slot] = self.tags[slot], tag
                digest, self.keys[slot] = self.keys[slot], digest
                value, self.values[slot] = self.values[slot], value
                bucket = self._other(bucket, tag)
                free = next((s for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS) if not self.tags[s]), -1)
                if free >= 0:
                    self.tags[free], self.keys[free], self.values[free] = tag, digest, value
                    self.live += 1
                    return
            self._grow()  # overflow: whoever is in hand now goes in again after it

    def _grow(self) -> None:
        kept = list(self.items())
        self._alloc(2 * (self.mask + 1))
        for digest, value in kept:
            self._insert(digest, value)


def text_digests(texts: pa.Array) -> list[bytes]:
    """sha256 of each text, A-Z lower-cased; null counts as empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return [hashlib.sha256(t.as_buffer()).digest() for t in lowered]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text_digests(batch.column(2)), pa.binary())], ["id", "row", "digest"])


_ENTRY = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])


def _best(a: tuple, b: tuple) -> tuple:
    """Of two (id, row): the larger id (null is least), then the earlier row."""
    rank = lambda x: (x[0] is not None, x[0] or 0, -x[1])
    return a if rank(a) >= rank(b) else b


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    out: list = []
    for digest, ((i, row), n) in index.items():
        out.append((digest, i, row, n))
        if len(out) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ENTRY)], schema=_ENTRY)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ENTRY)], schema=_ENTRY)


def _fold_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(batches, LIVE_DIGESTS)


def _fold(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """One entry a digest; with ``most`` the index is handed on and begun anew whenever it holds so many."""
    index = CuckooIndex()
    for batch in batches:
        if most and len(index) >= most:
            yield from _entries(index)
            index = CuckooIndex()
        counts = batch.column("n").to_pylist() if "n" in batch.schema.names else [1] * batch.num_rows
        for digest, i, row, n in zip(batch.column("digest").to_pylist(), batch.column("id").to_pylist(), batch.column("row").to_pylist(), counts):
            seen = index.get(digest)
            if seen is None:
                index.put(digest, ((i, row), n))
            else:
                index.put(digest, (_best(seen[0], (i, row)), seen[1] + n))
    yield from _entries(index)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null text counts as empty, so null and '' are one
    group.  The largest id stays; a null id is below every other.  Of repeated rows with the same id and text exactly one has
    kept = true.  An empty table gives no rows.  Extra columns are neither read nor clashed with.
    """
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    rows = written(rows.mapInArrow(_digest_batches, "id bigint, row bigint, digest binary"), "digests")
    entry = "digest binary, id bigint, row bigint, n bigint"
    parts = -(-rows.count() // LIVE_DIGESTS)  # at least so many tasks, that no index outgrows its own
    scanned = rows.mapInArrow(_fold_scan, entry)
    enough = parts <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = (scanned.repartition(F.col("digest")) if enough else scanned.repartition(parts, F.col("digest"))).mapInArrow(_fold, entry)
    groups = written(folded.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")), "groups")
    return rows.join(groups, "digest").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops: every distinct text once, all columns kept.

    Rows are matched by id, and where ids repeat by id and digest; a repeated row is left once.  Texts don't move unless more than
    BROADCAST_ROWS rows are dropped: those that are dropped go to the scan, not the rows to them.
    """
    names = docs.columns
    decided = exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept")
    decided = written(decided, "decided")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    rows = numbered(docs).withColumn("id", F.col(f"c{names.index(id_col)}").cast("bigint"))
    own = [f"c{i}" for i in range(len(names))]
    same_id = lambda a, b: a["id"].eqNullSafe(b["id"])
    if decided.groupBy("id").count().where("count > 1").isEmpty():
        gone = written(decided.where("not kept").select("id"), "dropped")
        return rows.join(small(gone), same_id(rows, gone), "left_anti").select(*own).toDF(*names)
    # (id, digest) of rows of which none stays, and of those of which one row of several stays
    pairs = decided.groupBy("id", "sha").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = written(pairs.where("not stays or n > 1").select("id", "sha", "stays"), "dropped")
    again = gone.where("stays")
    lowered = F.translate(F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumn("sha", F.sha2(lowered.cast("binary"), 256))
    both = lambda b: same_id(rows, b) & (rows["sha"] == b["sha"])
    single = rows.join(small(gone), both(gone), "left_anti")
    once = rows.join(small(again), both(again), "left_semi").dropDuplicates(["id", "sha"])
    return single.union(once).select(*own).toDF(*names)


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
