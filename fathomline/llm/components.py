"""Connected components over an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component: the least node.

    Alternating large-star and small-star rounds: the number of rounds grows with
    the logarithm of the longest chain, edges never multiply, and hot nodes are
    aggregated on the map side. Each round is a written table. Null ends and loops
    are ignored; an empty table gives an empty one; repeated edges count once.
    """
    now = scratch.save(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        after = scratch.save(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
