"""The driver's queries on the library, each with its SQL where SQL can express it."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import impurity as I
from .functions import indexing
from .functions.fuzzysets import singleton_partition, triangular_partition
from .functions.tnorms import tnorm
from .operators.fuzzify import feature_bins, fuzzify
from .operators import search
from .operators.growth import FuzzyTreeClassifier, _route_binary, _route_multi, node_arrays
from .operators.model import FuzzyTreeModel, Node, error_rate, merge_confidences
from .operators.stats import node_stats, prefix_stats
from .plans.params import Metadata, TreeParams
from .sources.readers import reservoir_sample

QUANTITY, DISCOUNT = [1.0, 13.0, 25.0, 38.0, 50.0], [0.0, 0.025, 0.05, 0.075, 0.1]
SIZE, PRICE = [1.0, 13.0, 26.0, 38.0, 50.0], [900.0, 925.0, 950.0, 975.0, 1000.0]
LABEL3 = "case when l_quantity < 17 then 0 when l_discount < 0.055e0 then 1 else 2 end"
FEATURES = ["l_quantity", "l_discount"]
_ROUND = 6
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lineitem(spark, d):
    return _read(spark, d, "lineitem").select(*FEATURES).withColumn("y", F.expr(LABEL3))


def _params(split="multi_split", **more):
    return TreeParams(**({"split": split, "num_classes": 3, "max_bins": 100, "cores": {0: QUANTITY, 1: DISCOUNT}} | more))


def _frontier(spark, d):
    bins = fuzzify(_lineitem(spark, d), FEATURES, "y", Metadata(_params(), 2, 1))
    return bins.select(F.lit(1).cast("long").alias("node_id"), "label", "bins", F.lit(1.0).alias("ad"), "w")


# SQL pieces -----------------------------------------------------------------------------------------------------------
def _d(x):
    return f"{x!r}::DOUBLE"


def _mu(x, cores, i):
    """Degree of x in set i of a strong partition."""
    b = cores[i]
    up = f"when {x} < {_d(b)} then " + (f"greatest(0::DOUBLE, ({x} - {_d(cores[i - 1])}) / {_d(b - cores[i - 1])})" if i else "1::DOUBLE")
    down = f"else greatest(0::DOUBLE, 1 - ({x} - {_d(b)}) / {_d(cores[i + 1] - b)})" if i + 1 < len(cores) else "else 1::DOUBLE"
    return f"case {up} when {x} = {_d(b)} then 1::DOUBLE {down} end"


def _fired(table, features, label):
    """(feature, bin, label, md) rows of fired sets."""
    parts = [f"select {k} as feature, {i} as bin, {label} as label, {_mu(c, cores, i)} as md from {table}" for k, (c, cores) in enumerate(features) for i in range(len(cores))]
    return "select * from (" + " union all ".join(parts) + ") where md > 0"


_LINE = [("l_quantity", QUANTITY), ("l_discount", DISCOUNT)]
_STATS = f"select feature, bin, label, sum(md) as u, count(*) as freq from ({_fired('lineitem', _LINE, LABEL3)}) group by all"
_XLX = lambda x: f"(case when {x} > 0 then {x} * ln({x}) else 0 end)"
_H = lambda parts, total: f"(case when {total} > 0 then ({_XLX(total)} - ({' + '.join(map(_XLX, parts))})) / ({total} * ln(2)) else 0 end)"
_WIDE = f"select feature, bin, coalesce(sum(u) filter (label = 0), 0) as m0, coalesce(sum(u) filter (label = 1), 0) as m1, coalesce(sum(u) filter (label = 2), 0) as m2, sum(u) as t from ({_STATS}) group by all"
_N = lambda x: f"floor(round({x}, 9))"


def _wide(stats: DataFrame, *keys: str, classes: int = 3) -> DataFrame:
    return stats.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("u"))), F.lit(0.0)).alias(f"m{k}") for k in range(classes)), F.sum("u").alias("t"))


# functions ------------------------------------------------------------------------------------------------------------
@_query("select 0 as feature, (i - 1)::INTEGER as idx, lag(b) over (order by i) as a, b, lead(b) over (order by i) as c from (values (1, 1e0), (2, 13e0), (3, 25e0), (4, 38e0), (5, 50e0)) t(i, b) "
        "union all select 1, v - 1, null, v::DOUBLE, null from range(1, 6) r(v)".replace("v - 1", "(v - 1)::INTEGER"))
def partition_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, i, s.a, s.b, s.c) for i, s in enumerate(triangular_partition(QUANTITY))] + [(1, i, None, s.b, None) for i, s in enumerate(singleton_partition([3, 1, 2, 5, 4]))]
    return spark.createDataFrame(rows, "feature int, idx int, a double, b double, c double")


_PART = " union all ".join(f"select p_partkey, {k} as feature, {i} as bin, round({_mu(c + '::DOUBLE', cores, i)}, 6) as md from part where {_mu(c + '::DOUBLE', cores, i)} > 0" for k, (c, cores) in enumerate([("p_size", SIZE), ("p_retailprice", PRICE)]) for i in range(5))


@_query(_PART)
def fuzzify_triangular_part(spark, sf_dir):
    bins = F.array(*(feature_bins(F.col(c), triangular_partition(cores)) for c, cores in (("p_size", SIZE), ("p_retailprice", PRICE))))
    out = _read(spark, sf_dir, "part").select("p_partkey", F.posexplode(bins).alias("feature", "fired")).select("p_partkey", "feature", F.inline("fired"))
    return out.select("p_partkey", "feature", "bin", F.round("md", 6).alias("md"))


@_query("select o_orderkey, left(o_orderpriority, 1)::INTEGER - 1 as bin, 1::DOUBLE as md from orders")
def fuzzify_singleton_orders(spark, sf_dir):
    code = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    out = _read(spark, sf_dir, "orders").select("o_orderkey", feature_bins(code, singleton_partition(range(5))).alias("b"))
    return out.select("o_orderkey", F.inline("b"))


@_query(f"select round(min(s), 6) as low, round(max(s), 6) as high, count(*) as n from (select {' + '.join(_mu('l_quantity', QUANTITY, i) for i in range(5))} as s from lineitem)")
def strong_partition_check(spark, sf_dir):
    s = sum((x.membership(F.col("l_quantity")) for x in triangular_partition(QUANTITY)), F.lit(0.0))
    out = _read(spark, sf_dir, "lineitem").select(s.alias("s"))
    return out.agg(F.round(F.min("s"), 6).alias("low"), F.round(F.max("s"), 6).alias("high"), F.count("*").alias("n"))


def _tnorm_query(name, sql):
    a, b = triangular_partition(QUANTITY)[1], triangular_partition(DISCOUNT)[2]

    def f(spark, sf_dir):
        t = tnorm(name).column(a.membership(F.col("l_quantity")), b.membership(F.col("l_discount")))
        return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(t), 4).alias("mass"), F.count("*").alias("n"))

    f.__name__ = f"tnorm_{name}"
    m1, m2 = _mu("l_quantity", QUANTITY, 1), _mu("l_discount", DISCOUNT, 2)
    _query(f"select l_returnflag, round(sum({sql.format(a=m1, b=m2)}), 4) as mass, count(*) as n from lineitem group by 1")(f)


_tnorm_query("product", "({a}) * ({b})")
_tnorm_query("min", "least(1::DOUBLE, {a}, {b})")


# statistics -----------------------------------------------------------------------------------------------------------
@_query(f"select feature, bin, label, round(u, 4) as u, freq from ({_STATS})")
def root_stats(spark, sf_dir):
    s = node_stats(_frontier(spark, sf_dir), tnorm("product"))
    return s.select("feature", "bin", "label", F.round("u", 4).alias("u"), "freq")


@_query(f"select feature, bin, round({_H(['m0', 'm1', 'm2'], 't')}, 6) as entropy, {_N('t')}::BIGINT as weight, (case when {_N('t')} = 0 then 0 when m0 >= m1 and m0 >= m2 then 0 when m1 >= m2 then 1 else 2 end)::INTEGER as majority from ({_WIDE})")
def bin_entropy(spark, sf_dir):
    w = _wide(node_stats(_frontier(spark, sf_dir), tnorm("product")), "feature", "bin")
    m = [F.col(f"m{k}") for k in range(3)]
    return w.select("feature", "bin", F.round(I.entropy(m), 6).alias("entropy"), I.weight(F.col("t")).cast("long").alias("weight"), I.majority(F.array(*m)).alias("majority"))


@_query(f"select label as class, round(u / sum(u) over (), 6) as weight, round(max(u) over () / sum(u) over (), 6) as purity from (select label, sum(u) as u from ({_STATS}) where feature = 0 group by 1)")
def node_class_weights(spark, sf_dir):
    w = _wide(node_stats(_frontier(spark, sf_dir), tnorm("product")).where("feature = 0"), "feature")
    masses = F.array("m0", "m1", "m2")
    out = w.select(F.posexplode(I.class_weights(masses)).alias("class", "weight"), F.try_divide(F.array_max(masses), F.col("t")).alias("purity"))
    return out.select("class", F.round("weight", 6).alias("weight"), F.round("purity", 6).alias("purity"))


_NODE_H = f"(select {_H(['m0', 'm1', 'm2'], 't')} as h from (select sum(m0) as m0, sum(m1) as m1, sum(m2) as m2, sum(t) as t from ({_WIDE}) where feature = 0))"
_GAIN = f"select feature, {_NODE_H} - sum({_H(['m0', 'm1', 'm2'], 't')} * {_N('t')}) / sum({_N('t')}) as gain from ({_WIDE}) group by 1"


def _root(spark, sf_dir, split):
    """What the learner's search takes at the root: masses and counts, metadata, history, impurity."""
    meta = Metadata(_params(split), 2, 1_000_000)
    u, f = node_arrays(node_stats(_frontier(spark, sf_dir), tnorm("product")).collect(), [1], meta)[1]  # bins x classes rows a feature
    return u, f, meta, {}, I.entropy_value(u[0].sum(0))


@_query(f"select feature, round(gain, 6) as gain from ({_GAIN})")
def multi_gain_root(spark, sf_dir):
    found = search.multi_candidates(*_root(spark, sf_dir, "multi_split"))
    return spark.createDataFrame([(c.feature, round(float(c.gain), 6)) for c in found], "feature int, gain double")


@_query(f"select feature, round(gain, 6) as gain from ({_GAIN}) where gain >= 1e-6 order by round(gain, 12) desc, feature limit 1")
def multi_best_feature_root(spark, sf_dir):
    found = search.best_multi(*_root(spark, sf_dir, "multi_split"))
    return spark.createDataFrame([(found.feature, round(float(found.gain), 6))] if found else [], "feature int, gain double")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_best_feature_root(spark, sf_dir)


_PREFIX = f"select feature, bin, label, sum(u) over (partition by feature, label order by bin) as l, sum(u) over (partition by feature, label) as t from (select f.feature, b.bin, y.label, coalesce(s.u, 0) as u from range(0, 2) f(feature), range(0, 5) b(bin), range(0, 3) y(label) left join ({_STATS}) s on s.feature = f.feature and s.bin = b.bin and s.label = y.label)"


def _dense_prefix(spark, sf_dir):
    s = node_stats(_frontier(spark, sf_dir), tnorm("product"))
    grid = spark.createDataFrame([(1, f, b, y) for f in range(2) for b in range(5) for y in range(3)], "node_id long, feature int, bin int, label int")
    dense = grid.join(s, ["node_id", "feature", "bin", "label"], "left").fillna(0.0, ["u"])
    return prefix_stats(dense)


@_query(f"select feature::INTEGER as feature, bin::INTEGER as bin, label::INTEGER as label, round(l, 4) as \"left\", round(t - l, 4) + 0 as \"right\" from ({_PREFIX})")
def binary_prefix_stats(spark, sf_dir):
    return _dense_prefix(spark, sf_dir).select("feature", "bin", "label", F.round("left", 4).alias("left"), (F.round("right", 4) + 0).alias("right"))


_SIDES = f"select feature, bin, {', '.join(f'sum(l) filter (label = {k}) as l{k}, sum(t - l) filter (label = {k}) as r{k}' for k in range(3))}, sum(l) as lt, sum(t - l) as rt from ({_PREFIX}) where bin < 4 group by 1, 2"
_BGAIN = f"select feature, bin, {_NODE_H} - ({_H(['l0', 'l1', 'l2'], 'lt')} * {_N('lt')} + {_H(['r0', 'r1', 'r2'], 'rt')} * {_N('rt')}) / ({_N('lt')} + {_N('rt')}) as gain from ({_SIDES})"


@_query(f"select feature::INTEGER as feature, bin::INTEGER as bin, round(gain, 6) as gain from (select *, row_number() over (partition by feature order by round(gain, 12) desc, bin) as k from ({_BGAIN})) where k = 1")
def binary_continuous_split(spark, sf_dir):
    found = search.binary_candidates(*_root(spark, sf_dir, "binary_split"))
    tops = [search.best([c for c in found if c.feature == k]) for k in range(2)]
    return spark.createDataFrame([(c.feature, int(max(c.bins)), round(float(c.gain), 6)) for c in tops if c], "feature int, bin int, gain double")


# categorical splits ---------------------------------------------------------------------------------------------------
_CAT = "select left(o_orderpriority, 1)::INTEGER - 1 as bin, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as label from orders"
_CATW = f"select bin, {', '.join(f'(count(*) filter (label = {k}))::DOUBLE as m{k}' for k in range(3))}, count(*)::DOUBLE as t from ({_CAT}) group by 1"


def _category_root(df, feature, label, classes, arity):
    """As _root(), for one categorical feature (codes from 0)."""
    meta = Metadata(TreeParams(num_classes=classes, max_bins=100, categories={0: arity}), 1, 1_000_000)
    rows = fuzzify(df.select(feature.alias("x"), label.alias("y")), ["x"], "y", meta)
    stats = node_stats(rows.select(F.lit(1).cast("long").alias("node_id"), "label", "bins", F.lit(1.0).alias("ad"), "w"), tnorm("product"))
    u, f = node_arrays(stats.collect(), [1], meta)[1]  # arity x classes rows
    return u, f, meta, {}, I.entropy_value(u[0].sum(0))


def _orders_root(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return _category_root(_read(spark, d, "orders"), F.substring("o_orderpriority", 1, 1).cast("int") - 1, status, 3, 5)


@_query(f"select bin, round({_H(['m0', 'm1', 'm2'], 't')}, 6) as centroid, (row_number() over (order by round({_H(['m0', 'm1', 'm2'], 't')}, 12), bin))::INTEGER as place, sum(t) over (order by round({_H(['m0', 'm1', 'm2'], 't')}, 12), bin) as mass_left from ({_CATW})")
def ordered_categorical_split_mc(spark, sf_dir):
    u = _orders_root(spark, sf_dir)[0][0]
    order = search.centroid_order(u, 3)
    left = np.cumsum([u[b].sum() for b in order])
    rows = [(int(b), round(I.entropy_value(u[b]), 6), i, float(left[i - 1])) for i, b in enumerate(order, 1)]
    return spark.createDataFrame(rows, "bin int, centroid double, place int, mass_left double")


_BRAND = "select substr(p_brand, 7)::INTEGER - 1 as bin, (p_size > 25)::INTEGER as label from part"
_BRANDW = f"select b.bin::INTEGER as bin, (count(*) filter (label = 0))::DOUBLE as m0, (count(*) filter (label = 1))::DOUBLE as m1 from range(0, 25) b(bin) left join ({_BRAND}) p on p.bin = b.bin group by 1"
_BRANDC = f"select bin, m0, m1, m0 + m1 as t, case when m0 + m1 = 0 then 1e300 when m1 > m0 then 1 else 0 end as centroid from ({_BRANDW})"
_BRANDL = f"select *, row_number() over (order by centroid, bin) as place, sum(m0) over w as l0, sum(m1) over w as l1, sum(m0) over () as a0, sum(m1) over () as a1 from ({_BRANDC}) window w as (order by centroid, bin)"
_BRANDG = f"select *, {_H(['a0', 'a1'], '(a0 + a1)')} - ({_H(['l0', 'l1'], '(l0 + l1)')} * (l0 + l1) + {_H(['(a0 - l0)', '(a1 - l1)'], '(a0 + a1 - l0 - l1)')} * (a0 + a1 - l0 - l1)) / (a0 + a1) as gain from ({_BRANDL})"


@_query(f"select place::INTEGER as place, bin, centroid::DOUBLE as centroid, l0 + l1 as mass_left, case when gain >= 1e-6 then round(gain, 6) end as gain from ({_BRANDG}) where place < 25")
def ordered_categorical_split_2c(spark, sf_dir):
    """Two classes: categories in order of their majority class, and the gain of each place to cut; null where it is too small."""
    about = _category_root(_read(spark, sf_dir, "part"), F.substring("p_brand", 7, 2).cast("int") - 1, (F.col("p_size") > 25).cast("int"), 2, 25)
    u, rows = about[0][0], []
    for i, c in enumerate(search.binary_candidates(*about), 1):
        b = c.bins[-1]
        weighs = I.weight_value(float(u[b].sum())) > 0
        rows.append((i, int(b), float(np.argmax(u[b])) if weighs else 1e300, float(c.masses[0].sum()), None if c.gain == search.INVALID else round(float(c.gain), 6)))
    return spark.createDataFrame(rows, "place int, bin int, centroid double, mass_left double, gain double")


@_query("select code::BIGINT as code, [j for j in [4, 3, 2, 1, 0] if (code >> j) & 1 = 1]::INTEGER[]::VARCHAR as bins from range(1, 16) r(code)")
def unordered_subsets(spark, sf_dir):
    codes = spark.range(1, 1 << 4).withColumnRenamed("id", "code")
    listed = F.concat(F.lit("["), F.array_join(indexing.subset_positions_column(F.col("code"), 5).cast("array<string>"), ", "), F.lit("]"))
    return codes.select("code", listed.alias("bins"))


_SUB = f"select code, {', '.join(f'coalesce(sum(m{k}) filter ((code >> bin) & 1 = 1), 0) as l{k}, coalesce(sum(m{k}) filter ((code >> bin) & 1 = 0), 0) as r{k}' for k in range(3))} from range(1, 16) s(code), ({_CATW}) group by 1"
_SUBT = f"select *, l0 + l1 + l2 as lt, r0 + r1 + r2 as rt, l0 + r0 as a0, l1 + r1 as a1, l2 + r2 as a2 from ({_SUB})"


@_query(f"select code, case when gain >= 1e-6 then round(gain, 6) end as gain from (select code::BIGINT as code, {_H(['a0', 'a1', 'a2'], '(lt + rt)')} - ({_H(['l0', 'l1', 'l2'], 'lt')} * lt + {_H(['r0', 'r1', 'r2'], 'rt')} * rt) / (lt + rt) as gain from ({_SUBT}))")
def unordered_categorical_split(spark, sf_dir):
    """Every subset of the five priorities as the left side; masses by category are summed once and then combined."""
    rows = [(sum(1 << b for b in c.bins), None if c.gain == search.INVALID else round(float(c.gain), 6)) for c in search.binary_candidates(*_orders_root(spark, sf_dir))]
    return spark.createDataFrame(rows, "code long, gain double")


@_query("select * from (values (3, 100, true, 3), (10, 100, false, 9), (5, 32, true, 15), (6, 32, false, 5)) t(arity, max_bins, unordered, splits)")
def feature_order_decision(spark, sf_dir):
    rows = []
    for arity, bins in ((3, 100), (10, 100), (5, 32), (6, 32)):
        meta = Metadata(TreeParams(num_classes=3, max_bins=bins, categories={0: arity}), 1, 10_000)
        rows.append((arity, bins, 0 in meta.unordered, meta.num_splits(0)))
    return spark.createDataFrame(rows, "arity int, max_bins int, unordered boolean, splits int")


@_query("select i::BIGINT as id, (2 * i)::BIGINT as left_id, (2 * i + 1)::BIGINT as right_id, (i >> 1)::BIGINT as parent_id, floor(log2(i))::INTEGER as level, (i > 1 and i % 2 = 0) as is_left from range(1, 128) r(i)")
def heap_index_math(spark, sf_dir):
    i = F.col("id")
    return spark.range(1, 128).select("id", F.shiftleft(i, 1).alias("left_id"), (F.shiftleft(i, 1) + 1).alias("right_id"), F.shiftright(i, 1).alias("parent_id"), indexing.level_column(i).alias("level"), ((i > 1) & (i % 2 == 0)).alias("is_left"))


# routing, scoring -----------------------------------------------------------------------------------------------------
@_query(f"select bin as child, label, round(sum(md), 4) as ad, count(*) as n from ({_fired('lineitem', _LINE[:1], LABEL3)}) group by 1, 2")
def route_multi_level1(spark, sf_dir):
    splits = spark.createDataFrame([(1, 0, 0)], "node_id long, feature int, first_child long")
    out = _route_multi(_frontier(spark, sf_dir).withColumn("hist", F.create_map().cast("map<int,int>")), splits, tnorm("product"))
    return out.groupBy(F.col("node_id").cast("int").alias("child"), "label").agg(F.round(F.sum("ad"), 4).alias("ad"), F.count("*").alias("n"))


_LEFT_MU = f"({_mu('l_quantity', QUANTITY, 0)}) + ({_mu('l_quantity', QUANTITY, 1)})"


@_query(f"select side::INTEGER as child, label, round(sum(ad), 4) as ad, count(*) as n from (select 2 as side, {LABEL3} as label, {_LEFT_MU} as ad from lineitem where l_quantity < 25 union all select 3, {LABEL3}, 1 - ({_LEFT_MU}) from lineitem where l_quantity > 13) group by 1, 2")
def route_binary_level1(spark, sf_dir):
    splits = spark.createDataFrame([(1, 0, [0, 1], 2, 3)], "node_id long, feature int, left_bins array<int>, left_id long, right_id long")
    out = _route_binary(_frontier(spark, sf_dir).withColumn("hist", F.create_map().cast("map<int,int>")), splits, tnorm("product"))
    return out.groupBy(F.col("node_id").cast("int").alias("child"), "label").agg(F.round(F.sum("ad"), 4).alias("ad"), F.count("*").alias("n"))


_MU5 = ", ".join(f"{_mu('l_quantity', QUANTITY, i)} as m{i}" for i in range(5))
# the bins' degrees, by which side of the first split (bins 0, 1 | 2, 3, 4) they lie on, and of the second
_REUSE = f"select {LABEL3} as label, *, m0 + m1 > 0 and m2 + m3 + m4 > 0 as two from (select l_quantity, l_discount, {_MU5} from lineitem)"


@_query(f"""select child::INTEGER as child, label, round(sum(ad), 4) as ad, count(*) as n from (
    select 4 as child, label, case when m1 > 0 then m0 else 1::DOUBLE end as ad from ({_REUSE}) where m0 > 0
    union all select 5, label, case when two then m1 when m0 > 0 then m1 else 1::DOUBLE end from ({_REUSE}) where m1 > 0
    union all select 6, label, case when two then m2 when m3 > 0 then m2 else 1::DOUBLE end from ({_REUSE}) where m2 > 0
    union all select 7, label, case when two then m2 when m2 > 0 then m3 else 1::DOUBLE end from ({_REUSE}) where two or m3 + m4 > 0
) group by 1, 2""")
def route_binary_reuse(spark, sf_dir):
    """A binary tree that splits on one feature twice: a row that the first split parts has its degree from there, and goes on by all its fired bins."""
    rows = _frontier(spark, sf_dir).withColumn("hist", F.create_map().cast("map<int,int>"))
    for splits in ([(1, 0, [0, 1], 2, 3)], [(2, 0, [0], 4, 5), (3, 0, [2], 6, 7)]):
        rows = _route_binary(rows, spark.createDataFrame(splits, "node_id long, feature int, left_bins array<int>, left_id long, right_id long"), tnorm("product"))
    return rows.groupBy(F.col("node_id").cast("int").alias("child"), "label").agg(F.round(F.sum("ad"), 4).alias("ad"), F.count("*").alias("n"))


_WEIGHTS = [(0.9, 0.1), (0.7, 0.3), (0.5, 0.5), (0.25, 0.75), (0.1, 0.9)]


def _leaf(node_id, level, weights, parent=1, value_index=None):
    return Node(node_id, level, parent=parent, value_index=value_index, u=np.array(weights), f=np.ones(len(weights)))


def _inner(node_id, level, feature, children, left_bins=(), parent=None):
    return Node(node_id, level, parent=parent, is_leaf=False, feature=feature, left_bins=left_bins, gain=0.1, u=np.ones(2), f=np.ones(2), children=list(children))


def _fixed_model(split: str) -> FuzzyTreeModel:
    """Multi-way: one level on p_size with given leaves. Binary: p_size, then p_retailprice on the left and p_size again on the right."""
    meta = Metadata(TreeParams(split=split, max_bins=100, cores={0: SIZE, 1: PRICE}), 2, 1000)
    if meta.params.binary:
        nodes = [_inner(1, 0, 0, (2, 3), (0, 1)), _inner(2, 1, 1, (4, 5), (0, 1, 2), 1), _inner(3, 1, 0, (6, 7), (2,), 1), *(_leaf(i, 2, w, i // 2) for i, w in zip(range(4, 8), _WEIGHTS))]
    else:
        nodes = [_inner(1, 0, 0, range(2, 7)), *(_leaf(i + 2, 1, w, 1, i) for i, w in enumerate(_WEIGHTS))]
    return FuzzyTreeModel(meta, {n.node_id: n for n in nodes}, ["size", "price"])


def _parts(spark, d):
    return _read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).cast("int").alias("label"))


def _fixed_scores(spark, d, split="multi_split"):
    return _fixed_model(split).transform(_parts(spark, d), output="conf")


_SCORES = "select p_partkey, (p_size > 25)::INTEGER as label, " + ", ".join(" + ".join(f"({_mu('p_size::DOUBLE', SIZE, i)}) * {_d(w[k])}" for i, w in enumerate(_WEIGHTS)) + f" as c{k}" for k in range(2)) + " from part"


@_query(f"select p_partkey, round(c0, 6) as c0, round(c1, 6) as c1 from ({_SCORES})")
def score_multi_fixed(spark, sf_dir):
    return _fixed_scores(spark, sf_dir).select("p_partkey", F.round(F.col("conf")[0], 6).alias("c0"), F.round(F.col("conf")[1], 6).alias("c1"))


_S1, _S3 = (" + ".join(f"({_mu('p_size::DOUBLE', SIZE, i)})" for i in bins) for bins in ((0, 1), (2,)))
_P = " + ".join(f"({_mu('p_retailprice', PRICE, i)})" for i in range(3))
_LEAVES = f"""select p_partkey, d2 * p as g4, case when p <= 0 then d2 when p < 1 then d2 * (1 - p) else 0 end as g5,
    case when parted then (case when s3 > 0 then d3 else 0 end) else d3 * s3 end as g6, case when parted then (case when s3 > 0 then 0 else d3 end) else d3 * (1 - s3) end as g7
    from (select *, case when s1 > 0 then s1 else 0 end as d2, case when s1 <= 0 then 1 when s1 = 1 then 0 else 1 - s1 end as d3, s1 > 0 and s1 <> 1 as parted from (select p_partkey, {_S1} as s1, {_S3} as s3, {_P} as p from part))"""


@_query("select p_partkey, " + ", ".join("round(" + " + ".join(f"g{i} * {_d(w[k])}" for i, w in zip(range(4, 8), _WEIGHTS)) + f", 6) as c{k}" for k in range(2)) + f" from ({_LEAVES})")
def score_binary_fixed(spark, sf_dir):
    """A binary tree that uses a feature again: a row that its first split parted keeps its degree and goes one way."""
    return _fixed_scores(spark, sf_dir, "binary_split").select("p_partkey", F.round(F.col("conf")[0], 6).alias("c0"), F.round(F.col("conf")[1], 6).alias("c1"))


def _predicted(spark, d):
    return _fixed_model("multi_split").predict_class(_parts(spark, d))


_PRED = f"select *, (round(c1, 9) >= round(c0, 9))::INTEGER as prediction from ({_SCORES})"


@_query(f"select p_partkey, prediction from ({_PRED})")
def predict_class(spark, sf_dir):
    return _predicted(spark, sf_dir).select("p_partkey", "prediction")


@_query(f"select label, prediction, count(*) as n from ({_PRED}) group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return _predicted(spark, sf_dir).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@_query(f"select round(avg((label <> prediction)::INTEGER::DOUBLE), 9) as error_rate, round(1 - avg((label <> prediction)::INTEGER::DOUBLE), 9) as accuracy, count(*) as n from ({_PRED})")
def test_error(spark, sf_dir):
    e = error_rate(_predicted(spark, sf_dir), "label", "prediction")
    return e.select(F.round("error_rate", 9).alias("error_rate"), F.round("accuracy", 9).alias("accuracy"), "n")


test_error.__test__ = False


@_query(f"select p_partkey, round(c0, 6) as k0, round(c1 + 0.5, 6) as k1, 0.25::DOUBLE as k2 from ({_SCORES})")
def confidence_map_merge(spark, sf_dir):
    a = F.create_map(F.lit(0), F.col("conf")[0], F.lit(1), F.col("conf")[1])
    m = merge_confidences(a, F.create_map(F.lit(1), F.lit(0.5), F.lit(2), F.lit(0.25)))
    return _fixed_scores(spark, sf_dir).select("p_partkey", m.alias("m")).select("p_partkey", *(F.round(F.col("m")[k], 6).alias(f"k{k}") for k in range(3)))


# training -------------------------------------------------------------------------------------------------------------
def _train(spark, d, split, depth):
    return FuzzyTreeClassifier(_params(split, max_depth=depth)).fit(_lineitem(spark, d), FEATURES, "y")


def _nodes(model, spark):
    t = model.node_table(spark)
    return t.select("node_id", "level", "is_leaf", "feature", F.array_join(F.array_sort("bins").cast("array<string>"), ",").alias("bins"), F.round("gain", 6).alias("gain"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 3).alias("mass"))


# The learner unrolled to depth 2 --------------------------------------------------------------------------------------
_RID = "with line as materialized (select row_number() over () as rid, l_quantity, l_discount, " + LABEL3 + " as label from lineitem), fired as materialized (select * from (" + " union all ".join(f"select rid, label, {k} as feature, {i} as bin, {_mu(c, cores, i)} as md from line" for k, (c, cores) in enumerate(_LINE) for i in range(len(cores))) + ") where md > 0)"
_M3 = ", ".join(f"coalesce(sum({{u}}) filter (label = {k}), 0) as m{k}" for k in range(3))
_H3 = _H(["m0", "m1", "m2"], "(m0 + m1 + m2)")
_PURE = "greatest(m0, m1, m2) >= m0 + m1 + m2"
_MULTI2 = f"""{_RID},
stats1 as (select feature, bin, {_M3.format(u='md')}, count(*) as freq from fired group by 1, 2),
root as (select sum(m0) as m0, sum(m1) as m1, sum(m2) as m2 from stats1 where feature = 0),
root_h as (select *, {_H3} as h from root),
gain1 as (select feature, (select h from root_h) - sum(h * n) / sum(n) as gain from (select feature, {_H3} as h, {_N('(m0 + m1 + m2)')} as n from stats1) group by 1),
best1 as (select * from gain1 where gain >= 1e-6 order by round(gain, 12) desc, feature limit 1),
kids as (select b.bin as i, coalesce(s.m0, 0) as m0, coalesce(s.m1, 0) as m1, coalesce(s.m2, 0) as m2, coalesce(s.freq, 0) as freq
  from range(0, 5) b(bin) cross join best1 left join stats1 s on s.feature = best1.feature and s.bin = b.bin),
kids_h as (select *, {_H3} as h from kids),
grown as (select * from kids_h where h > 0 and m0 + m1 + m2 > 0 and freq > 1),
stats2 as (select g.i, o.feature, o.bin, {_M3.format(u='k.md * o.md').replace('label', 'o.label')} from fired k join best1 on k.feature = best1.feature join grown g on g.i = k.bin join fired o on o.rid = k.rid and o.feature <> k.feature group by 1, 2, 3),
gain2 as (select s.i, feature, any_value(g.h) - sum(s.h * n) / sum(n) as gain from (select i, feature, {_H3} as h, {_N('(m0 + m1 + m2)')} as n from stats2) s join grown g on g.i = s.i group by 1, 2),
split2 as (select g.i, x.feature, x.gain, row_number() over (order by g.i) as k from grown g join gain2 x on x.i = g.i and x.gain >= 1e-6 where not ({_PURE})),
nodes as (
  select 1::BIGINT as node_id, 0 as level, feature is null as is_leaf, feature, case when feature is null then '' else '0,1,2,3,4' end as bins, gain, m0 + m1 + m2 as mass from root left join best1 on true
  union all select 2 + k.i, 1, s.i is null, s.feature, case when s.i is null then '' else '0,1,2,3,4' end, s.gain, k.m0 + k.m1 + k.m2 from kids k left join split2 s on s.i = k.i
  union all select 7 + 5 * (s.k - 1) + b.bin, 2, true, null, '', null, coalesce(x.m0 + x.m1 + x.m2, 0) from split2 s cross join range(0, 5) b(bin) left join stats2 x on x.i = s.i and x.bin = b.bin)
select node_id, level::INTEGER as level, is_leaf, feature::INTEGER as feature, bins, round(gain, 6) as gain, round(mass, 3) as mass from nodes"""

_SIDES3 = ", ".join(f"sum(m{k}) filter (bin <= s) as l{k}, sum(m{k}) filter (bin > s) as r{k}" for k in range(3))
_BOTH_H = f"({_H(['l0', 'l1', 'l2'], '(l0 + l1 + l2)')} * {_N('(l0 + l1 + l2)')} + {_H(['r0', 'r1', 'r2'], '(r0 + r1 + r2)')} * {_N('(r0 + r1 + r2)')}) / ({_N('(l0 + l1 + l2)')} + {_N('(r0 + r1 + r2)')})"
_BINARY2 = f"""{_RID},
stats1 as (select f.feature, b.bin, coalesce(m0, 0) as m0, coalesce(m1, 0) as m1, coalesce(m2, 0) as m2, coalesce(freq, 0) as freq from range(0, 2) f(feature) cross join range(0, 5) b(bin)
  left join (select feature, bin, {_M3.format(u='md')}, count(*) as freq from fired group by 1, 2) s on s.feature = f.feature and s.bin = b.bin),
root as (select sum(m0) as m0, sum(m1) as m1, sum(m2) as m2 from stats1 where feature = 0),
gain1 as (select feature, s, (select {_H3} from root) - {_BOTH_H} as gain from (select feature, s, {_SIDES3} from stats1 cross join range(0, 4) c(s) group by 1, 2)),
best1 as (select * from gain1 where gain >= 1e-6 order by round(gain, 12) desc, feature, s limit 1),
kids as (select n as id, x.feature as own, x.s, sum(m0) as m0, sum(m1) as m1, sum(m2) as m2, sum(freq) as freq from stats1 join best1 x on x.feature = stats1.feature join range(2, 4) k(n) on (bin <= s) = (n = 2) group by 1, 2, 3),
grown as (select * from (select *, {_H3} as h from kids) where h > 0 and m0 + m1 + m2 > 0 and freq >= 1),
sides as (select rid, feature, count(*) filter (bin <= s) > 0 and count(*) filter (bin > s) > 0 as parted, s, any_value(label) as label from fired join best1 using (feature) group by 1, 2, 4),
routed as (select distinct on (d.rid, g.id) d.rid, g.id, d.label, case when d.parted then f.md else 1::DOUBLE end as ad from sides d join fired f on f.rid = d.rid and f.feature = d.feature join grown g on (f.bin <= d.s) = (g.id = 2) order by d.rid, g.id, f.bin),
stats2 as (select r.id, f.feature, f.bin, {_M3.format(u='case when f.feature = g.own then 1 else f.md end * r.ad').replace('label', 'r.label')}, count(*) as freq
  from routed r join grown g on g.id = r.id join fired f on f.rid = r.rid where f.feature <> g.own or (f.bin <= g.s) = (r.id = 2) group by 1, 2, 3),
gain2 as (select c.id, feature, c.s, any_value(g.h) - any_value({_BOTH_H}) as gain from (
    select x.id, x.feature, c.s, {", ".join(f"coalesce(sum(m{k}) filter (bin between x.lo and c.s), 0) as l{k}, coalesce(sum(m{k}), 0) - coalesce(sum(m{k}) filter (bin between x.lo and c.s), 0) as r{k}" for k in range(3))}
    from (select g.id, f.feature, case when f.feature = g.own and g.id = 3 then g.s + 1 else 0 end as lo, case when f.feature = g.own and g.id = 2 then g.s else 4 end as hi from grown g cross join range(0, 2) f(feature)) x
    join range(0, 4) c(s) on c.s >= x.lo and c.s < x.hi left join stats2 z on z.id = x.id and z.feature = x.feature group by 1, 2, 3) c join grown g on g.id = c.id group by 1, 2, 3),
split2 as (select *, row_number() over (partition by x.id order by round(gain, 12) desc, feature, x.s) as k from gain2 x where gain >= 1e-6 and x.id in (select id from grown where not ({_PURE})) qualify k = 1),
leaves as (select p.id * 2 + n as node_id, coalesce(sum(z.m0 + z.m1 + z.m2) filter ((z.bin between (case when p.feature = g.own and g.id = 3 then g.s + 1 else 0 end) and p.s) = (n = 0)), 0) as mass
  from split2 p join grown g on g.id = p.id cross join range(0, 2) c(n) left join stats2 z on z.id = p.id and z.feature = p.feature group by 1),
bins as (select 1 as id, string_agg(b::VARCHAR, ',' order by b) as bins from best1 join range(0, 5) r(b) on b <= s union all
  select p.id, string_agg(b::VARCHAR, ',' order by b) from split2 p join grown g on g.id = p.id join range(0, 5) r(b) on b between (case when p.feature = g.own and g.id = 3 then g.s + 1 else 0 end) and p.s group by 1),
nodes as (
  select 1::BIGINT as node_id, 0 as level, feature is null as is_leaf, feature, gain, m0 + m1 + m2 as mass from root left join best1 on true
  union all select k.id, 1, p.id is null, p.feature, p.gain, k.m0 + k.m1 + k.m2 from kids k left join split2 p on p.id = k.id
  union all select node_id, 2, true, null, null, mass from leaves)
select node_id, level::INTEGER as level, is_leaf, feature::INTEGER as feature, coalesce(bins, '') as bins, round(gain, 6) as gain, round(mass, 3) as mass from nodes left join bins on bins.id = node_id"""


@_query(_MULTI2)
def train_multi(spark, sf_dir):
    return _nodes(_train(spark, sf_dir, "multi_split", 2), spark)


@_query(_BINARY2)
def train_binary_depth2(spark, sf_dir):
    return _nodes(_train(spark, sf_dir, "binary_split", 2), spark)


@_query()
def train_binary(spark, sf_dir):
    return _nodes(_train(spark, sf_dir, "binary_split", 4), spark)


@_query()
def trained_error(spark, sf_dir):
    """Error of a binary tree on its training rows."""
    scored = _train(spark, sf_dir, "binary_split", 4).predict_class(_lineitem(spark, sf_dir))
    return error_rate(scored, "y", "prediction")


#: (tree, id, parent, rows): a binary tree and a multi-way one; children are in order of their ids.
_NODES = [("binary_split", 1, None, 100), ("binary_split", 2, 1, 60), ("binary_split", 3, 1, 40), ("binary_split", 4, 2, 50), ("binary_split", 5, 2, 10), ("binary_split", 10, 5, 10), ("binary_split", 11, 5, 0),
          ("multi_split", 1, None, 100), ("multi_split", 2, 1, 0), ("multi_split", 3, 1, 70), ("multi_split", 4, 1, 30), ("multi_split", 5, 3, 0), ("multi_split", 6, 3, 70), ("multi_split", 7, 6, 70), ("multi_split", 8, 6, 0)]
_VALUES = "(values " + ", ".join(f"('{t}', {i}, {'null' if p is None else p}, {n})" for t, i, p, n in _NODES) + ") n(tree, id, parent, freq)"
_WALK = f"""with recursive nodes as (select * from {_VALUES}),
walk(tree, id, depth, path, freq, top) as (select tree, id, 0, [id], freq, 0 from nodes where parent is null union all select n.tree, n.id, w.depth + 1, list_append(w.path, n.id), n.freq, case when w.depth = 0 then n.id else w.top end from nodes n join walk w on n.parent = w.id and n.tree = w.tree),
flat as (select *, not exists (select 1 from nodes n where n.tree = walk.tree and n.parent = walk.id) as leaf from walk)"""


def _literal_model(split: str) -> FuzzyTreeModel:
    rows = {i: (p, n) for t, i, p, n in _NODES if t == split}
    nodes: dict = {}
    for i, (p, n) in rows.items():
        kids = [c for c, (q, _) in rows.items() if q == i]
        nodes[i] = Node(i, nodes[p].level + 1 if p else 0, parent=p, is_leaf=not kids, feature=0 if kids else None, left_bins=(0,), u=np.array([n, 0.0]), f=np.array([n, 0.0]), children=kids)
    return FuzzyTreeModel(Metadata(TreeParams(split=split, cores={0: SIZE}), 1, 100), nodes, ["x"])


@_query(f"""{_WALK}, firsts as (select tree, top, depth from flat where leaf and freq > 0 and top > 0 qualify row_number() over (partition by tree, top order by path) = 1)
select tree as split, (count(*) filter (tree = 'binary_split' or depth = 0 or freq > 0))::INTEGER as nodes, (count(*) filter (leaf and freq > 0))::INTEGER as leaves, max(depth)::INTEGER as depth,
  (min(depth) filter (leaf))::INTEGER as min_depth, case when tree = 'binary_split' then avg(depth) filter (leaf) else (select avg(depth) from firsts f where f.tree = flat.tree) end as average_depth, max(id)::INTEGER as max_id from flat group by tree""")
def model_metrics(spark, sf_dir):
    rows = []
    for split in ("binary_split", "multi_split"):
        m = _literal_model(split)
        rows.append((split, m.num_nodes, m.num_leaves, m.depth, m.min_depth, float(m.average_depth), m.max_id()))
    return spark.createDataFrame(rows, "split string, nodes int, leaves int, depth int, min_depth int, average_depth double, max_id int")


@_query(f"{_WALK} select tree, (row_number() over (partition by tree order by path))::INTEGER as place, id::BIGINT as id, depth::INTEGER as depth from flat")
def tree_walk(spark, sf_dir):
    """Depth-first iteration."""
    rows = [(split, i, n.node_id, n.level) for split in ("binary_split", "multi_split") for i, n in enumerate(_literal_model(split).subtree(), 1)]
    return spark.createDataFrame(rows, "tree string, place int, id long, depth int")


@_query()
def sample_reservoir(spark, sf_dir):
    return reservoir_sample(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), 100)
