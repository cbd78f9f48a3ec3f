"""Connected components of a graph given as an edge table: local forests, then pointer doubling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _local_forests(batches):
    """Edges of one task to one edge per node, to the smallest node it reaches within the task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"]
        )


def _doubled(steps, parent: DataFrame) -> DataFrame:
    """Node to root, from node to parent (a < its parent never holds): the depth halves with every stored round."""
    while True:
        up = parent.select(F.col("a").alias("b"), F.col("b").alias("up"))
        step = steps.store(parent.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")))
        parent = step.select("a", "b")
        if step.where("moved").limit(1).isEmpty():
            return parent


def components(steps, edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge table (a, b): the root is the smallest node that can be reached.

    Edges are dealt by ranges of nodes, so chains of neighbouring nodes shrink inside a task; every node then points to
    its smallest neighbour, pointers are doubled to the end, and edges between different ends are what is left for the
    next round.  Every round is stored, so lineage stays short.
    """
    down = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = steps.store(down(edges))
    known = None
    while not now.limit(1).isEmpty():
        stars = steps.store(now.repartitionByRange("a").mapInArrow(_local_forests, "a bigint, b bigint"))
        roots = _doubled(steps, stars.groupBy("a").agg(F.min("b").alias("b")))
        if known is None:
            known = roots
        else:  # earlier ends go on to the new ones
            later = roots.select(F.col("a").alias("b"), F.col("b").alias("end"))
            moved = known.join(later, "b", "left").select("a", F.coalesce("end", "b").alias("b"))
            known = steps.store(moved.unionByName(roots.join(known, "a", "left_anti")))
        left, right = roots.select("a", F.col("b").alias("x")), roots.select(F.col("a").alias("b"), F.col("b").alias("y"))
        ends = stars.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")
        )
        now = steps.store(down(ends))
    if known is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    ends = known.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root")).distinct()
