"""Best-fit-decreasing sharding of indivisible groups.

Groups of equal texts are the items, and every one of them is packed.  Sizes are whole numbers, so the driver gets classes
(size, how many groups): the distinct sizes of items that sum to n number at most sqrt(2 n), and are far fewer in practice.  Best fit
decreasing takes a class in runs: the tightest bin with room for one item stays the tightest while it has room for another, so the
bins of a class are a few runs of its groups in the order of their keys, exactly those of the plain algorithm.  Groups find
their run by their rank within the class.  Bins lie in an AVL tree of remaining capacities.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_columns, written

ROWS_A_SLICE = 50_000
#: Up to so many classes the runs of each are broadcast; beyond it they are joined on the size.
BROADCAST_CLASSES = 200_000


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.left, self.right, self.height = key, None, None, 1


class CapacityTree:
    """An AVL tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _h(node: _Node | None) -> int:
        return node.height if node else 0

    def _fix(self, node: _Node) -> _Node:
        node.height = 1 + max(self._h(node.left), self._h(node.right))
        lean = self._h(node.left) - self._h(node.right)
        if lean > 1:
            if self._h(node.left.left) < self._h(node.left.right):
                node.left = self._turn(node.left, "right", "left")
            return self._turn(node, "left", "right")
        if lean < -1:
            if self._h(node.right.right) < self._h(node.right.left):
                node.right = self._turn(node.right, "left", "right")
            return self._turn(node, "right", "left")
        return node

    def _turn(self, node: _Node, up: str, down: str) -> _Node:
        top = getattr(node, up)
        setattr(node, up, getattr(top, down))
        setattr(top, down, node)
        node.height = 1 + max(self._h(node.left), self._h(node.right))
        top.height = 1 + max(self._h(top.left), self._h(top.right))
        return top

    def add(self, key: tuple[int, int]) -> None:
        def into(node):
            if node is None:
                return _Node(key)
            side = "left" if key < node.key else "right"
            setattr(node, side, into(getattr(node, side)))
            return self._fix(node)

        self.root = into(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (capacity, bin) with capacity >= size."""
        found, node = None, self.root
        while node:
            if node.key >= (size, -1):
                found, node = node.key, node.left
            else:
                node = node.right
        if found is not None:
            self._remove(found)
        return found

    def _remove(self, key: tuple[int, int]) -> None:
        def out(node, key):
            if key < node.key:
                node.left = out(node.left, key)
            elif key > node.key:
                node.right = out(node.right, key)
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                least = node.right
                while least.left:
                    least = least.left
                node.key = least.key
                node.right = out(node.right, least.key)
            return self._fix(node)

        self.root = out(self.root, key)


def best_fit_decreasing(sizes: Iterable[tuple[object, int]], capacity: int) -> tuple[dict, list[int]]:
    """Pack (name, size) items into bins of a fixed capacity, opening a bin only where no open one has room.

    Returns the bin of each name and the load of each bin.  An item larger than the capacity raises ValueError.
    Ties go by name, then by bin number.
    """
    tree, where, loads = CapacityTree(), {}, []
    for name, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        if size > capacity:
            raise ValueError(f"{name!r} of size {size} exceeds the capacity {capacity}")
        found = tree.take_tightest(size)
        if found is None:
            loads.append(0)
            found = (capacity, len(loads) - 1)
        left, number = found
        where[name] = number
        loads[number] += size
        tree.add((left - size, number))
    return where, loads


def pack_classes(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """best_fit_decreasing of classes (size, count): by size the runs (end, bin), end being the rank in the class that the run stops
    before, and the load of each bin.  Packing gives up (and tells more than ``most`` loads) once it opens more than ``most`` bins."""
    tree, runs, loads = CapacityTree(), {}, []
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            raise ValueError(f"size {size} exceeds the capacity {capacity}")
        own, done = runs.setdefault(size, []), 0
        while done < count:
            found = tree.take_tightest(size)
            if found is None:
                loads.append(0)
                if most is not None and len(loads) > most:
                    return runs, loads
                found = (capacity, len(loads) - 1)
            left, number = found
            fit = min(count - done, left // size)
            done += fit
            own.append((done, number))
            loads[number] += size * fit
            tree.add((left - size * fit, number))
    return runs, loads


def pack_into(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """The runs of a capacity, found by bisection, for which best fit decreasing opens at most ``shards`` bins.

    Whether it does isn't monotone in the capacity, so a lesser capacity that would do as well may exist; one byte less than
    the one found was tried or is below the bound of the average and the largest group."""
    if not classes:
        return {}
    total, largest = sum(s * n for s, n in classes), max(s for s, _ in classes)
    low = max(-(-total // shards), largest)
    high, best = low, None
    while best is None:
        runs, loads = pack_classes(classes, high, shards)
        if len(loads) <= shards:
            best = runs
        else:
            low, high = high + 1, high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        runs, loads = pack_classes(classes, middle, shards)
        if len(loads) <= shards:
            best, high = runs, middle
        else:
            low = middle + 1
    return best


def _before(counts: DataFrame, within: str) -> DataFrame:
    """(within, slice, before): the rows of ``within`` in slices before this one, of counts (within, slice, n)."""
    return counts.select(within, "slice", (F.sum("n").over(Window.partitionBy(within).orderBy("slice")) - F.col("n")).alias("before"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), group_key.

    size is the UTF-8 length of the text plus 1; a null text has length 0, crc32 0, and is of the group of ''.  Shards
    number 0 to shards - 1; rows of one text are never in two shards, so a group larger than an average shard makes its shard
    larger.  Groups of one size are packed in the order of group_key.  slot numbers the rows of a shard from 0 without gaps, by slice of
    the row's hash, id, then row.  A null id is an id like any other, repeated rows get slots of their own, and an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = own_columns(docs, id=id_col, text=text_col).select(
        F.col("id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group_key"),
    )
    rows = written(rows, "sized")
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")), "sizes")
    spark = docs.sparkSession
    n, items = rows.count(), groups.count()
    # rank of a group among those of its size by key: a slice is a common beginning of keys, so ranks don't depend on how many there are
    digits = next(d for d in range(5) if items <= ROWS_A_SLICE * 16**d or d == 4)
    sliced = groups.withColumn("slice", F.substring("group_key", 1, digits))
    counts = written(sliced.groupBy("bytes", "slice").agg(F.count(F.lit(1)).alias("n")), "classes")
    classes = [(r.bytes, r.n) for r in counts.groupBy("bytes").agg(F.sum("n").alias("n")).toLocalIterator()]
    runs = pack_into(classes, shards)
    schema = "bytes bigint, ends array<bigint>, bins array<int>"
    made = [(size, [e for e, _ in own], [b for _, b in own]) for size, own in runs.items()]
    placed = spark.createDataFrame(made, schema)
    placed = F.broadcast(placed) if len(made) <= BROADCAST_CLASSES else placed
    inside = F.row_number().over(Window.partitionBy("bytes", "slice").orderBy("group_key")) - 1
    ranked = sliced.withColumn("inside", inside).join(_before(counts, "bytes"), ["bytes", "slice"]).withColumn("rank", F.col("before") + F.col("inside"))
    run = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    found = written(ranked.join(placed, "bytes").select("group_key", F.get("bins", run).alias("shard")), "shards")
    slices = max(1, n // ROWS_A_SLICE)
    rows = written(rows.join(found, "group_key").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))), "placed")
    before = _before(rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")), "shard")
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "row")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(before) if shards * slices <= BROADCAST_CLASSES else before, ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("inside")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "group_key",
        )
    )
