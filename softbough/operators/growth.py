"""Level-wise growth: one aggregation per group of open nodes, over an incremental frontier."""
from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.impurity import entropy_value
from ..functions.indexing import left as left_id, level, right as right_id
from ..functions.tnorms import tnorm as tnorm_by_name
from ..plans.params import Metadata, TreeParams
from .fuzzify import fuzzify
from .model import FuzzyTreeModel, Node
from .search import best_binary, best_multi
from .stats import node_stats

_ALLOWED = "node_id long, feature int, bins array<int>"


def _route_binary(frontier: DataFrame, splits: DataFrame, tnorm) -> DataFrame:
    """Each row to the children it fires. All fired bins on one side: there, degree unchanged; else both, and the degree
    falls only the first time the feature parts the row (hist remembers the side's bin)."""
    rows = frontier.join(F.broadcast(splits), "node_id").withColumn("fired", F.get("bins", F.col("feature")))
    inside = F.filter("fired", lambda s: F.array_contains("left_bins", s["bin"]))
    outside = F.filter("fired", lambda s: ~F.array_contains("left_bins", s["bin"]))
    rows = rows.withColumn("lin", inside).withColumn("lout", outside)
    both = (F.size("lin") > 0) & (F.size("lout") > 0)
    known = F.coalesce(F.map_contains_key("hist", F.col("feature")), F.lit(False))

    def child(node, side):
        ad = F.when(~both | known, F.col("ad")).otherwise(tnorm.column(F.col("ad"), F.get(side, F.lit(0))["md"]))
        entry = F.create_map(F.col("feature"), F.get(side, F.lit(0))["bin"])
        hist = F.when(~both, F.col("hist")).otherwise(F.map_concat(F.map_filter("hist", lambda k, _: k != F.col("feature")), entry))
        return F.when(F.size(side) > 0, F.struct(F.col(node).alias("node"), ad.alias("ad2"), hist.alias("hist2")))

    kids = F.array_compact(F.array(child("left_id", "lin"), child("right_id", "lout")))
    out = rows.select("label", "bins", "w", F.inline(kids))
    return out.where("node is not null").select(F.col("node").alias("node_id"), "label", "bins", F.col("ad2").alias("ad"), F.col("hist2").alias("hist"), "w")


def _route_multi(frontier: DataFrame, splits: DataFrame, tnorm) -> DataFrame:
    rows = frontier.join(F.broadcast(splits), "node_id").withColumn("fired", F.get("bins", F.col("feature")))
    rows = rows.select("label", "bins", "ad", "hist", "w", "first_child", F.inline("fired")).where("md <> 0")
    return rows.select((F.col("first_child") + F.col("bin")).alias("node_id"), "label", "bins", tnorm.column(F.col("ad"), F.col("md")).alias("ad"), "hist", "w")


def _groups(nodes: list, meta: Metadata):
    """Open nodes in order, as many at once as max_memory_mb of statistics allow; one at least."""
    size = max(1, meta.params.max_memory_mb * (1 << 20) // meta.node_bytes())
    return [nodes[i : i + size] for i in range(0, len(nodes), size)]


def node_arrays(rows, nodes, meta: Metadata) -> dict:
    """node -> (masses, counts), for each feature an array bins x classes, from rows of node_stats()."""
    empty = lambda: [np.zeros((meta.bins(f), meta.params.num_classes)) for f in range(meta.num_features)]
    stats = {n: (empty(), empty()) for n in nodes}
    for r in rows:
        stats[r.node_id][0][r.feature][r.bin, r.label] = r.u
        stats[r.node_id][1][r.feature][r.bin, r.label] = r.freq
    return stats


def weighted(df: DataFrame, features: list[str], label: str, few: bool) -> tuple[DataFrame, str]:
    """df's label and features with a weight column, whose name is returned: equal rows become one if they are few, else each row has weight 1."""
    names = list(dict.fromkeys([label, *features]))
    w = "_" * max(map(len, names)) + "w"  # longer than any other name
    if few:
        return df.groupBy(*names).agg(F.count("*").alias(w)), w
    return df.select(*names, F.lit(1).cast("long").alias(w)), w


class FuzzyTreeClassifier:
    """fit(df, features, label) gives a FuzzyTreeModel. Features are numeric columns, categorical ones codes from 0.

    Rows that agree in label and features are grown as one weighted row where a sketch says that they are at most a quarter of all rows
    (one aggregation with map-side combine); else the rows themselves are grown and nothing is shuffled for it.
    """

    def __init__(self, params: TreeParams):
        self.params = params

    def fit(self, df: DataFrame, features: list[str], label: str) -> FuzzyTreeModel:
        p = self.params
        seen = df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(label, *features)).alias("d")).first()
        meta = Metadata(p, len(features), seen.n)
        if meta.node_bytes() > p.max_memory_mb << 20:
            raise ValueError("the statistics of one node take more than max_memory_mb")
        if p.subsampling_rate < 1:
            df = df.sample(p.subsampling_rate, p.seed)
        spark, tnorm = df.sparkSession, tnorm_by_name(p.tnorm)
        rows, w = weighted(df, features, label, seen.d * 4 <= seen.n)
        frontier = fuzzify(rows, features, label, meta, w).select(F.lit(1).cast("long").alias("node_id"), "label", "bins", F.lit(1.0).alias("ad"), F.create_map().cast("map<int,int>").alias("hist"), "w")
        frontier = frontier.persist(StorageLevel.MEMORY_AND_DISK)
        root = Node(1, 0)
        nodes, open_, next_id, old = {1: root}, [root], 2, []
        while open_:
            rows = []
            for group in _groups(open_, meta):
                used = [(n.node_id, f, None if b is None else sorted(b)) for n in group for f, b in n.history.items()]
                allowed = spark.createDataFrame([(n, f, b if b is not None else [-1]) for n, f, b in used], _ALLOWED) if used else None
                part = frontier if len(group) == len(open_) else frontier.where(F.col("node_id").isin([n.node_id for n in group]))
                rows += node_stats(part, tnorm, allowed, not p.binary).collect()  # bounded by max_memory_mb a group
            stats = node_arrays(rows, [n.node_id for n in open_], meta)
            splits, grown = [], []
            for node in open_:
                u, f = stats[node.node_id]
                if node.u is None:
                    node.u, node.f = u[0].sum(0), f[0].sum(0)
                    node.impurity = entropy_value(node.u)
                best = best_binary(u, f, meta, node.history, node.impurity) if p.binary else best_multi(u, f, meta, set(node.history), node.impurity)
                total = float(node.u.sum())
                pure = total > 0 and float(node.u.max()) / total >= p.max_purity
                if best is None or best.gain <= 0 or node.level == p.max_depth or pure:
                    node.is_leaf = True
                    continue
                node.is_leaf, node.feature, node.gain, node.left_bins = False, best.feature, best.gain, best.bins
                node.children = []
                first = next_id
                for i in range(2 if p.binary else len(best.bins)):
                    history = dict(node.history)
                    if p.binary:
                        mine = set(history.get(best.feature) or range(meta.bins(best.feature)))
                        history[best.feature] = set(best.bins) if i == 0 else mine - set(best.bins)
                        own = left_id(node.node_id) if i == 0 else right_id(node.node_id)
                    else:
                        history[best.feature] = None
                        own, next_id = next_id, next_id + 1
                    kid = Node(own, level(own) if p.binary else node.level + 1, history=history, parent=node.node_id, value_index=None if p.binary else i)
                    kid.u, kid.f, kid.impurity = np.asarray(best.masses[i]), np.asarray(best.counts[i]), best.impurities[i]
                    freq = float(kid.f.sum())
                    few = freq < p.min_instances if p.binary else freq <= p.min_instances
                    kid.is_leaf = bool(kid.level == p.max_depth or kid.impurity <= 0 or float(kid.u.sum()) <= p.min_fuzzy_instances or few)
                    node.children.append(own)
                    nodes[own] = kid
                    if not kid.is_leaf:
                        grown.append(kid)
                alive = {k.node_id for k in grown}
                if p.binary:
                    a, b = left_id(node.node_id), right_id(node.node_id)
                    splits.append((node.node_id, best.feature, list(best.bins), a if a in alive else None, b if b in alive else None))
                else:
                    splits.append((node.node_id, best.feature, first))
            open_ = grown
            if open_:
                # splits has a row for each node just split, at most those of one level of a tree the driver holds
                if p.binary:
                    new = _route_binary(frontier, spark.createDataFrame(splits, "node_id long, feature int, left_bins array<int>, left_id long, right_id long"), tnorm)
                else:
                    new = _route_multi(frontier, spark.createDataFrame(splits, "node_id long, feature int, first_child long"), tnorm)
                    new = new.join(F.broadcast(spark.createDataFrame([(n.node_id,) for n in open_], "node_id long")), "node_id", "left_semi")
                old.append(frontier)
                if grown[0].level % 4 == 0 and spark.sparkContext.getCheckpointDir():
                    new = new.checkpoint()  # a lost executor's rows are made again from here
                frontier = new.persist(StorageLevel.MEMORY_AND_DISK)
                while len(old) > 2:  # the last two levels stay, from which a lost partition is made again
                    old.pop(0).unpersist()
        for f in [*old, frontier]:
            f.unpersist()
        return FuzzyTreeModel(meta, nodes, list(features))
