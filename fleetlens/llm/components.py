"""Connected components of a link table by alternating large and small stars, every round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (a, b), loops left out.

    A node's neighbours are only ever reduced to their least, so a node with very many of them is an aggregate and a
    join, not a list. Rounds grow with the logarithm of the longest chain."""
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour is linked to the least of the node's surroundings
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        ).where("u <> v").distinct()
        new = stored(small)
        # done when all edges are stars: nothing is both a root and linked to a smaller node
        open_ = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = new.groupBy("u").count().where("count > 1")
        edges = new
        if open_.isEmpty() and twice.isEmpty():
            roots = new.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
