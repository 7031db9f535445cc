"""Connected components: of few edges in one task, of more by alternating large-star and small-star rounds.

Rounds over few edges would cost far more in files (one for each partition of three tables a round) than in edges.

In the rounds, edges live in checkpointed tables.  Minima are aggregated with map-side
combination, and every join is between two plain exchanges, whose skewed
partitions (the star of a large group) adaptive execution splits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task closes; more are closed in rounds.
ALONE = 1 << 16


class Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _closed(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.unite(a, b)
    pairs = [(x, forest.find(x)) for x in list(forest.parent)]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, longs, read twice); the root is the smallest node."""
    edges = edges.filter("a <> b")
    if edges.count() <= alone:
        return edges.select("a", "b").repartition(1).mapInArrow(_closed, "node long, root long")
    e = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = _state(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
        large = cut(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        rest = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")
        e = cut(rest.union(least.select("hi", "m")).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
