"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v), root being the smallest node of the component.

    Large-star and small-star steps by turns: each is an aggregation with a map-side part and a join of the edges with
    one row per node, so a hub is neither gathered in one group nor multiplied. Both sides of a join are written first:
    then Spark can split a hub's edges.
    """
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        cur = written(small.where("u <> v").distinct(), "edges")
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if now == before:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
