"""Connected components over an edge table, as alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, store


def connected_components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows. Each
    round is two aggregations with map-side combine and two equi-joins; the edge table is
    written to the shared folder between rounds and nothing but two numbers reaches the driver.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    e = store(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = store(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == was:
            break
        was = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
