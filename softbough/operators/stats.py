"""Sufficient statistics of open nodes: masses and counts by (node, feature, bin, label)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(frontier: DataFrame) -> DataFrame:
    """One row for each (row, node, feature, fired bin)."""
    return frontier.select("node_id", "label", "ad", "w", F.posexplode("bins").alias("feature", "fired")).select("node_id", "label", "ad", "w", "feature", F.inline("fired"))


def node_stats(frontier: DataFrame, tnorm, allowed: DataFrame | None = None, multi: bool = False) -> DataFrame:
    """sum of T(u, ad) and number of rows by (node_id, feature, bin, label); a row counts w times.

    allowed: (node_id, feature, bins) for features already used on a node's path. In a binary tree only those bins
    count there, with degree T(1, ad) each; in a multi-way tree a used feature is no candidate. It is
    small (open nodes x used features) and its size is left to the optimizer's own broadcast limit.
    """
    rows = exploded(frontier)
    u = F.col("md")
    if allowed is not None:
        rows = rows.join(allowed, ["node_id", "feature"], "left")
        if multi:
            rows = rows.where("bins is null")
        else:
            rows = rows.where("bins is null or array_contains(bins, bin)")
            u = F.when(F.col("bins").isNull(), F.col("md")).otherwise(1.0)
    rows = rows.where(u != 0)
    return rows.groupBy("node_id", "feature", "bin", "label").agg(F.sum(tnorm.column(u, F.col("ad")) * F.col("w")).alias("u"), F.sum("w").alias("freq"))


def prefix_stats(stats: DataFrame, order: str = "bin", keys=("node_id", "feature", "label")) -> DataFrame:
    """Adds left (mass of the bins up to this one) and right (the rest) for each class; stats has a row for each bin and label."""
    w = Window.partitionBy(*keys)
    return stats.withColumn("left", F.sum("u").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("right", F.sum("u").over(w) - F.col("left"))
