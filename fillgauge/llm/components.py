"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgauge import session


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends the least of its neighbourhood to its larger neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends the least of its smaller neighbours to the others and itself."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    others = moved.where(F.col("a") > F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a < b``: the root is the least node that can be reached.

    Both steps keep what is connected; the links end as stars around the least
    nodes after a number of rounds that grows with the logarithm of the nodes. A
    star's centre is reduced before the shuffle, and adaptive execution splits it
    in the joins. Each round is written to the shared folder, so a lost executor
    costs a round at most. No links give no rows.
    """
    edges = session.materialise(edges.select("a", "b").where("a < b").distinct(), "links")
    before = None
    while True:
        edges = session.materialise(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = now
