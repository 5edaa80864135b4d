"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import Workspace

#: As many edges are reduced in one task, which holds their nodes.
EDGES_OF_A_TASK = 500_000


def _spanning(edges: DataFrame) -> DataFrame:
    """Edges (u, v) replaced, within each partition, by links from each node to its least one there.

    Components stay the same and at most one edge is left for each node and partition; memory is bounded by the
    nodes of one flush.
    """

    def run(batches: Iterator[pa.RecordBatch], flush: int = 500_000) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        def links() -> pa.RecordBatch:
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > flush:
                yield links()
                parent.clear()
        yield links()

    return edges.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node, larger or smaller ones, are linked to the least of them and the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.filter("v > u") if large else both
    out = linked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; the component is its least node.

    Edges within a partition are first reduced to a forest. What is left is one more such partition if it is no more
    than a task takes; else large and small stars alternate until each node is linked to its component's least node
    alone. Both are joins and partial aggregations, so no group meets in one task; the rounds grow with the logarithm
    of the longest path. Self-links and repeats do no harm; null ends are ignored.
    """
    work = Workspace(edges.sparkSession, "components")
    given = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v")
    now = work.keep(_spanning(given).distinct())
    if now.limit(EDGES_OF_A_TASK + 1).count() <= EDGES_OF_A_TASK:
        return _of_stars(_replaced(work, now, _spanning(now.coalesce(1))))
    for _ in range(max_rounds):
        if _are_stars(now):
            return _of_stars(now)
        now = _replaced(work, now, _star(_star(now, large=True), large=False))
    raise RuntimeError(f"no convergence in {max_rounds} rounds")


def _replaced(work: Workspace, old: DataFrame, new: DataFrame) -> DataFrame:
    """new as a written table in place of the old one it reads."""
    out = work.keep(new)
    work.drop(old)
    return out


def _of_stars(stars: DataFrame) -> DataFrame:
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """True if every node points to one other at most and none that is pointed to points on; edges lead to lesser nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()
