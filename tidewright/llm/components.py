"""Connected components of a distributed edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link every larger neighbour of a node to the least of its neighbourhood. Small star: link the smaller
    neighbours and the node itself."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of comparable nodes -> (node, root): the least node that each node of an edge can reach.

    Self-links and repeated edges don't matter. Every round is written to the shared scratch folder. The rounds grow
    with the logarithm of the nodes; a run that hasn't settled after `rounds` raises instead of returning part.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = saved(_stars(_stars(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
