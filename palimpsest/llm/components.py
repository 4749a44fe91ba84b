"""Union-find over links held in a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find of one task's links; one link per node to its root, the
    smallest id of its tree. Flushed when many nodes are held."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = [n for n in parent if find(n) != n]
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([find(n) for n in nodes], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield from stars()
            parent.clear()
    yield from stars()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` links: the label is the
    smallest node reachable. Self links are ignored.

    Tasks first shrink their links to forests by union-find. Then labels fall
    along links and jump to their label's label until nothing changes, which
    takes rounds in the logarithm of the longest path. Each round is two joins
    on ids; where one id carries many links, adaptive execution splits that side
    (the other holds one row per id). Every round is written, so a lost executor
    costs one round.
    """
    pairs = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b")
    shrunk = pairs.mapInArrow(_forest, "a bigint, b bigint")
    edges = written(shrunk.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        lowest = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        fallen = labels.join(lowest, labels["node"] == lowest["a"]).select(
            "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")
        )
        fallen = written(fallen, "fallen")
        up = fallen.select(F.col("node").alias("_up"), F.col("label").alias("_top"))
        jumped = fallen.join(up, fallen["label"] == up["_up"], "left").select(
            "node",
            F.least("label", F.coalesce("_top", "label")).alias("label"),
            (F.col("moved") | (F.coalesce("_top", "label") < F.col("label"))).alias("moved"),
        )
        state = written(jumped, "labels")
        labels = state.select("node", "label")
        if state.filter("moved").isEmpty():
            return labels

