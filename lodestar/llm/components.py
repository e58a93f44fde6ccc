"""Connected components of an edge table by alternating large-star and small-star.

Both stars are a groupBy for the smallest neighbour and a join back, so a hub's
links are never gathered in one task or list. Each round is written to the
shared folder; rounds end when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: any ordered type) but the roots themselves; root is the smallest node.

    Self-links, repeated and reversed links are allowed; links with a null are ignored.
    """
    now = scratch.write(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        following = scratch.write(_small_star(_large_star(now)))
        found = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(now)
        now = following
        if (found[0], found[1]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (found[0], found[1])
