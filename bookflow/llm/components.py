"""Connected components of a list of links, by alternating stars; every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookflow.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of a link: root is the smallest node that it reaches. Links to itself and repeated ones are allowed.

    Each step hangs every node on the smallest node next to it, first the larger neighbours, then the smaller ones; the number of steps
    grows with the logarithm of the longest chain.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stage(small.select(F.col("v").alias("u"), "m").unionByName(small.select("u", "m")).where("u <> m").select("u", F.col("m").alias("v")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
