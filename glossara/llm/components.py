"""Connected components of edges that no machine has to hold together: alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), each written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; edges hold u > v.  Every node links the neighbours of one side to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        # larger neighbours of each node; the least of node and neighbours is their new neighbour
        linked = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.least("u", "m").alias("v"))
    else:
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v")))
    return linked.distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node that has an edge to another."""
    stars = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        stars = cut(_star(_star(stars, True), False))
        # the sums of labels fall with every change; unchanged sums are a fixed point
        now = stars.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
