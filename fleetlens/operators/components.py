"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in ``edges`` (a, b: whole numbers, in any direction).

    Each node points to a node of its component that is no greater, at first to itself. In a round, every edge offers to
    each end, and to what that end points to, what the other end's pointer points to; each takes the least offer, and all
    pointers are then halved, each node pointing where its target points. Rounds grow with the logarithm of the longest
    path; offers are combined before they are shuffled, so a node of very many edges stays spread out.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    at = written(both.select(F.col("a").alias("node")).distinct().withColumn("to", F.col("node")), "pointers")
    while True:
        there = at.select(F.col("node").alias("b"), F.col("to").alias("offer"))
        here = at.select(F.col("node").alias("a"), F.col("to").alias("held"))
        offers = both.join(there, "b").groupBy("a").agg(F.min("offer").alias("offer")).join(here, "a")
        targets = F.explode(F.array(F.col("a"), F.col("held"))).alias("node")
        least = offers.filter("offer < held").select(targets, "offer").groupBy("node").agg(F.min("offer").alias("offer"))
        moved = at.join(least, "node", "left").select(
            "node", F.least("to", F.coalesce("offer", "to")).alias("to"), F.col("to").alias("before")
        )
        moved = written(moved, "pointers")
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("further"))
        halved = moved.join(jump, "to").select("node", F.col("further").alias("to"), "before")
        halved = written(halved, "pointers")
        if halved.filter("to <> before").isEmpty():
            return halved.select("node", F.col("to").alias("component"))
        at = halved.select("node", "to")
