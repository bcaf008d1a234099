"""Connected components by repeated contraction, all in DataFrames.

Every round takes each node to the least of itself and its neighbours, flattens the forest this makes by pointer
jumping, and moves the edges to the roots; a round at least halves the nodes that still have edges.  Minima are
aggregated before they move, and joins run on freshly dealt sides, so a hub is split rather than gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Nodes that a task contracts at a time.
NODES = 500_000


def _contract_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task, replaced by links of every node to the least node of its component, NODES nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def links() -> Iterator[pa.RecordBatch]:
        pairs = [(x, root(x)) for x in list(parent)]
        out = np.array([x for x in pairs if x[0] != x[1]], dtype=np.int64).reshape(-1, 2)
        for at in range(0, len(out), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(out[at : at + 65536, 1]), pa.array(out[at : at + 65536, 0])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= NODES:
            yield from links()
            parent.clear()
    yield from links()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a bigint, b bigint); root is the least node of its component.

    Loops, repeated edges and both directions are allowed; rows with a null end are ignored; no edges give no rows.
    """
    # written first, as edges mostly come from Python workers, and a task should not need two at a time
    live = written(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "links")
    live = written(live.mapInArrow(_contract_here, "a bigint, b bigint").distinct(), "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "parents")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
            jumped = written(up.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("next"), "root"), "jumped")
            moved = not jumped.where("next <> root").isEmpty()
            up = jumped.select("node", F.col("next").alias("root"))
            if not moved:
                break
        if labels is None:
            labels = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
            labels = written(labels.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "labels")
        left = live.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("b", "ra")
        moved_edges = left.join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        live = written(moved_edges.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    return labels
