"""Connected components of an edge list, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Every round points each node's larger neighbours at its smallest neighbour
    (large star), then each node and its smaller neighbours at the smallest (small
    star); paths shorten to stars in about log(n) rounds. A round never has more
    edges than the one before, so a group of copies costs as many edges as members.
    Edges with a null end and loops are ignored. Each round is written to the shared
    folder, so its lineage is short and a lost executor costs one round at most; tables
    of the round before are deleted.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.isnull(a).alias("na"), F.isnull(b).alias("nb"))
    links = store(start.filter("not na and not nb and u <> v").select("u", "v").distinct(), "links")
    state = None
    while True:
        # u > v on every row. Large star: the smallest neighbour m of a node takes over its larger neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        large, old = store(large.distinct(), "large-star"), links
        # Small star: a node's smallest neighbour takes over its smaller neighbours and the node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop(large, old)
        total = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (total["n"], total["h"]) == state:
            break
        state = (total["n"], total["h"])
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
