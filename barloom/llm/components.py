"""Connected components of links that live in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of links(a, b), itself included.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to the least node around it,
    then its smaller ones. Long chains halve at each turn; hot nodes are joined, never gathered in a group.
    """
    links = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where(F.col("a") != F.col("b")).distinct(), "links")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = stored(small.where(F.col("a") != F.col("b")).distinct(), "links")
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first())
        if state == seen or state[0] == state[2] and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        seen = state
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
