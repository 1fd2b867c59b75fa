"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.llm.common import Scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)`` either has one edge to its root or is a root; then all is found."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    sides = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sides.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the smallest node reachable.

    Each round keeps at most one edge a node and neighbour; a node with very many neighbours only
    meets a pre-aggregated minimum, and the join that spreads it is one that Spark can split. Rounds end
    when the edges are stars, which is seen without a further round.
    """
    current = scratch.put(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges0"
    )
    step = 0
    while not _is_forest_of_stars(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = scratch.put(large, f"large{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = scratch.put(small, f"edges{step + 1}")
        scratch.drop(f"edges{step}")
        scratch.drop(f"large{step}")
        current, step = following, step + 1
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())
