"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v: hang neighbours on the least of them.

    The minimum is aggregated before it meets the edges again, so a hub with
    any number of neighbours is never held together in one task.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (u, v), u > v, connected by one task."""
    kind, arrow = edges.schema["u"].dataType.simpleString(), edges.select("u").limit(0).toArrow().schema.field("u").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x: object) -> object:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted(map(find, pair))
                parent[b] = a
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([find(x) for x in nodes], arrow)], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the least node it reaches.

    Up to `at_once` edges go to one task, which needs no rounds.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    seen = mark(now)
    if 0 < seen[0] <= at_once:
        return _at_once(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        last, now = now, staged(_star(_star(now, True), False))
        removed(last)
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
