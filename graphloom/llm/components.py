"""Connected components of an edge table by alternating large-star and small-star steps; nothing is collected.

A star step is one aggregation (the smallest neighbour of each node) and one join; a node with very many neighbours is pre-aggregated
before the shuffle, and the join with its minimum may be split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge names; edges are undirected, loops do no harm."""
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u, and u, go to the smallest of them
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = checkpointed(small)
        # settled when it is a set of stars that this round didn't change
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (e, new))
        e = new
        if before == after:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
