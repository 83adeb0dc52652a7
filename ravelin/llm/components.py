"""Connected components by alternating star operations (Kiveris et al., 2014): O(log^2 n) rounds, each two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Rewire edges (a < b). Large: neighbours above a node move to its least one. Small: those below it do."""
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
    else:
        ways = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = ways.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    # The side of `least` is unique, so a node with very many neighbours can be split between tasks.
    met = ways.join(least, "u")
    moved = met.filter("v > u" if large else "v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), a < b, which aren't roots; a root is its component's least node."""
    at = materialize(edges.select("a", "b"), "edges")
    before = None
    for _ in range(most_rounds):
        mark = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return at.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = tuple(mark)
        at = materialize(_star(_star(at, True), False), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
