"""Connected components: contraction in bounded tasks and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import stage


#: Edges that one task contracts at most: what it holds of them is bounded by it.
TASK_EDGES = 400_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task contracted: each of their vertices with its root among them."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        top = v
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[v] != top:
            root[v], v = top, root[v]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(find(v), v) for v in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Staged edges with the same components, and how many tasks contracted them."""
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    spread = edges.coalesce(tasks) if tasks < edges.rdd.getNumPartitions() else edges.repartition(tasks)
    return stage(spread.mapInArrow(_forests, "a bigint, b bigint"), "edges"), tasks


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("a"))
    return both.join(least, "u").where("v > u and a <> v").select("a", F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex with an edge; the root is the component's least vertex.

    ``edges`` has two BIGINT columns. The least neighbour of a vertex is a map-side
    combined minimum and joins back by vertex, so a vertex with very many edges is a
    skewed join that adaptive execution splits, never one group in one task.
    """
    pairs = edges.toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Tasks contract what they hold, bounded; stars then bring their roots together, until
    # so little is left that one task finishes it.
    current, tasks = _contracted(stage(pairs, "edges"))
    while tasks > 1:
        current, tasks = _contracted(stage(_small_star(_large_star(current)), "edges"))
        if tasks > 1:
            mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            after = stage(_small_star(_large_star(current)), "edges")
            if after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == mark:
                break
            current = after
    return current.select(F.col("b").alias("vertex"), F.col("a").alias("root")).union(
        current.select("a", "a").distinct()
    )
