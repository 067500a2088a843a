"""Sets, t-norms, entropy, search, growth on small tables; queries against their SQL at the smallest scale."""
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from softbough import queries as Q
from softbough.functions import impurity, indexing
from softbough.functions.fuzzysets import fuzzy_set_builder, singleton_partition, triangular_partition, triangular_set
from softbough.functions.tnorms import tnorm
from softbough.operators.fuzzify import categorical_bins, continuous_bins
from softbough.operators.growth import FuzzyTreeClassifier
from softbough.operators.model import FuzzyTreeModel
from softbough.operators.search import centroid_order, gain_of
from softbough.plans.params import Metadata, TreeParams
from softbough.sources.readers import from_rows

DATA = "/root/testdata/sf0.001"


def test_partitions_add_up():
    sets = triangular_partition([5, 1, 3, 2, 4])
    assert [s.b for s in sets] == [1, 2, 3, 4, 5] and sets[0].a is None and sets[-1].c is None
    for x in np.linspace(-1, 7, 33):
        assert math.isclose(sum(s.value(x) for s in sets), 1.0)
    assert [s.b for s in singleton_partition([3, 1, 2])] == [1, 2, 3]
    for bad in ([1], [1, 1]):
        with pytest.raises(ValueError):
            triangular_partition(bad)
    with pytest.raises(ValueError):
        triangular_set([1, 2])
    with pytest.raises(ValueError):
        fuzzy_set_builder("round")


def test_numbers():
    assert indexing.subset_positions(13, 10) == [3, 2, 0]
    assert [indexing.left(3), indexing.right(3), indexing.parent(7), indexing.level(9)] == [6, 7, 3, 3]
    assert impurity.entropy_value([1, 1]) == pytest.approx(1) and impurity.entropy_value([0, 0]) == 0
    assert tnorm("PRODUCT").value(0.5, 0.5) == 0.25 and tnorm("min").value(0.5, 2) == 0.5
    assert centroid_order(np.array([[1.0, 9.0], [9.0, 1.0], [0.0, 0.0]]), 2) == [1, 0, 2]
    assert gain_of([[0.4, 0.1], [0.2, 0.1]], 1.0, 0)[0] < -1e300  # nothing weighs anything


@pytest.mark.parametrize("bad", [dict(num_classes=1), dict(max_depth=31), dict(max_bins=1), dict(tnorm="x"), dict(impurity="gini"), dict(split="x"), dict(max_purity=0), dict(subsampling_rate=0), dict(categories={0: 2}, cores={0: [0, 1]})])
def test_params(bad):
    with pytest.raises(ValueError):
        TreeParams(**bad)


def test_order_of_features():
    meta = lambda arity, classes: Metadata(TreeParams(num_classes=classes, max_bins=100, categories={0: arity}), 1, 1000)
    assert 0 not in meta(2, 2).unordered and 0 in meta(3, 100).unordered and meta(3, 100).num_splits(0) == 3
    assert 0 not in meta(10, 100).unordered and meta(10, 100).num_splits(0) == 9
    with pytest.raises(ValueError):
        meta(1, 2)
    with pytest.raises(ValueError):
        Metadata(TreeParams(), 1, 10)


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 2.5, 5.0, 10.0, 99.0)], "x double")
    got = [[(b.bin, round(b.md, 6)) for b in r.b] for r in df.select(continuous_bins(F.col("x"), [0, 5, 10]).alias("b")).collect()]
    assert got == [[(0, 1)], [(0, 1)], [(0, 0.5), (1, 0.5)], [(1, 1)], [(2, 1)], [(2, 1)]]
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "x double").select(continuous_bins(F.col("x"), [0, 5])).collect()
    for bad in (3.0, 0.5, -1.0, float("nan"), None):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "x double").select(categorical_bins(F.col("x"), 3)).collect()


@pytest.mark.parametrize("split, arity", [("binary_split", 2), ("binary_split", 10), ("multi_split", 2)])
def test_categorical_tree(spark, split, arity, tmp_path):
    rows = [(1, (0, 1))] * 60 + [(0, (1, 0))] * 40
    p = TreeParams(split=split, max_depth=2, max_bins=100, categories={0: arity, 1: arity})
    model = FuzzyTreeClassifier(p).fit(from_rows(spark, rows, ["a", "b"]), ["a", "b"], "label")
    assert (model.num_nodes, model.num_leaves, model.depth) == (3, 2, 1)
    got = model.predict_class(from_rows(spark, rows, ["a", "b"])).select("label", "prediction").collect()
    assert all(r.label == r.prediction for r in got)
    model.save(spark, str(tmp_path / "m"))
    again = FuzzyTreeModel.load(spark, str(tmp_path / "m"))
    assert again.debug_string() == model.debug_string() and again.predict_row([0, 1]) == model.predict_row([0, 1])


def test_unordered_training(spark):
    rows = [(y, (c,)) for c, y in ((0, 0), (1, 1), (2, 2), (3, 0)) for _ in range(20)]
    p = TreeParams(max_depth=3, max_bins=100, num_classes=3, categories={0: 4})
    model = FuzzyTreeClassifier(p).fit(from_rows(spark, rows, ["c"]), ["c"], "label")
    assert 0 in model.meta.unordered and set(model.nodes[1].left_bins) in ({0, 3}, {1, 2})
    assert [max(model.predict_row([c]).items(), key=lambda x: x[1])[0] for c in range(4)] == [0, 1, 2, 0]


def test_stream_scores(spark, tmp_path):
    from softbough.streaming.scoring import score_stream

    rows = [(int(x > 5), (float(x),)) for x in range(11)]
    df = from_rows(spark, rows, ["x"])
    model = FuzzyTreeClassifier(TreeParams(max_depth=2, cores={0: [0, 5, 10]})).fit(df, ["x"], "label")
    df.write.parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model, name="streamed")
    q.processAllAvailable()
    q.stop()
    want = sorted(r.prediction for r in model.predict_class(df).collect())
    assert sorted(r.prediction for r in spark.sql("select prediction from streamed").collect()) == want


@pytest.mark.parametrize("split", ["multi_split", "binary_split"])
def test_rows_that_fire_nothing(spark, split):
    """NaN and null lie in no set, unknown categories neither; compiled expressions, Arrow batches and single rows agree."""
    rows = [(int(x > 5) + c % 2, (float(x), c)) for x in range(11) for c in range(3)]
    p = TreeParams(split=split, max_depth=3, max_bins=100, num_classes=3, cores={0: [0, 5, 10]}, categories={1: 3})
    model = FuzzyTreeClassifier(p).fit(from_rows(spark, rows, ["x", "c"]), ["x", "c"], "label")
    odd = [(1.0, 5.0), (float("nan"), 1.0), (None, 1.0), (3.0, None), (float("nan"), float("nan")), (float("inf"), 2.0), (-3.0, 0.0), (4.0, 1.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(odd)], "id int, x double, c double")
    ways = [{r.id: r.confidences for r in model.transform(df, compiled_paths=n).collect()} for n in (10**6, 0)]
    classes = {r.id: r.prediction for r in model.predict_class(df).collect()}
    for i, values in enumerate(odd):
        alone = model.predict_row([float("nan") if v is None else v for v in values])
        assert ways[0][i] == pytest.approx(ways[1][i])
        assert ways[0][i] == pytest.approx(list(alone.values()))
        assert classes[i] == (max(range(3), key=lambda k: (ways[0][i][k], k)) if ways[0][i] else -1)
    if split == "multi_split":
        assert classes[4] == -1 and ways[0][4] == [] and -1 in (classes[0], classes[1])
    else:
        assert all(ways[0].values())  # a binary split has an else branch


def test_node_helpers(spark):
    m = Q._fixed_model("binary_split")
    again = m.copy()
    again.nodes[4].u[0] = 99
    assert m.nodes[4].u[0] == 0.9 and m.nodes[4].frequencies() == [0.5, 0.5] and not m.nodes[4].is_mono_label()
    row = spark.range(1).select(impurity.class_frequencies(F.array(F.lit(3), F.lit(1))).alias("f"), impurity.is_mono_label(F.array(F.lit(3), F.lit(0))).alias("m"), impurity.is_mono_label(F.array(F.lit(3), F.lit(1))).alias("n")).first()
    assert row.f == [0.75, 0.25] and row.m and not row.n
    lines = m.debug_string().splitlines()
    assert lines[0] == "Fuzzy tree (binary) of depth 2 with 7 nodes and 4 leaves" and lines[1].endswith("If size in [0, 1]") and lines[3].endswith("Predict: 0: 0.9, 1: 0.1") and len(lines) == 11


@pytest.mark.parametrize("split", ["binary_split", "multi_split"])
def test_weighted_rows(spark, split, monkeypatch):
    """Equal rows grown as one give the tree of the rows themselves."""
    from softbough.operators import growth

    rows = [(int(a > 4) + int(b > 6), (float(a), float(b))) for a in range(11) for b in range(11) for _ in range(1 + (a * b) % 9)]
    df = from_rows(spark, rows, ["a", "_w"])
    p = TreeParams(split=split, max_depth=5, max_bins=100, num_classes=3, cores={0: [0, 5, 10], 1: [0, 3, 7, 10]})
    trees, plain = [], growth.weighted
    for few in (True, False):
        monkeypatch.setattr(growth, "weighted", lambda df, features, label, _: plain(df, features, label, few))
        model = FuzzyTreeClassifier(p).fit(df, ["a", "_w"], "label")
        trees.append([(n.node_id, n.feature, n.left_bins, n.f.tolist(), n.u.round(6).tolist()) for n in model.nodes.values()])
    assert trees[0] == trees[1] and len(trees[0]) > 3


def test_labels_in_bounds(spark):
    p = TreeParams(cores={0: [0, 5]})
    for bad in (2, -1):
        with pytest.raises(Exception, match="label outside"):
            FuzzyTreeClassifier(p).fit(from_rows(spark, [(0, (1.0,)), (bad, (2.0,))], ["x"]), ["x"], "label")


def test_splits_samples_and_cores(spark):
    from softbough.functions.fuzzysets import equal_width_cores, quantile_cores
    from softbough.sources.readers import split_by_hash

    df = spark.range(1000)
    a, b = split_by_hash(df, "id", 3, 4)
    assert a.count() + b.count() == 1000 and a.intersect(b).count() == 0 and 650 < a.count() < 850
    assert equal_width_cores(0, 10, 5) == [0, 2.5, 5, 7.5, 10] and quantile_cores(df, "id", 3) == [0, 499, 999]
    rows = [(int(x > 50), (float(x),)) for x in range(100)]
    model = FuzzyTreeClassifier(TreeParams(max_depth=1, cores={0: [0, 50, 100]}, subsampling_rate=0.5, seed=3)).fit(from_rows(spark, rows, ["x"]), ["x"], "label")
    assert 40 < model.nodes[1].f.sum() < 160 and model.meta.num_examples == 100  # each row fires two sets


def test_sets_bounds_and_defaults():
    from dataclasses import replace

    s = triangular_partition([1, 2, 4])
    assert [(x.a, x.b, x.c) for x in s] == [(None, 1, 2), (1, 2, 4), (2, 4, None)] and [(x.a, x.b, x.c) for x in singleton_partition([3])] == [(None, 3, None)]
    p = TreeParams(cores={0: [0, 1]})
    assert (p.split, p.tnorm, p.impurity, p.max_depth, p.max_bins, p.num_classes, p.min_info_gain, p.max_memory_mb) == ("binary_split", "product", "fuzzy_entropy", 10, 32, 2, 1e-6, 256)
    assert replace(p, tnorm="min").tnorm == "min" and p.tnorm == "product" and TreeParams(split="multi_split").max_depth == 5


def test_history_of_ordered_categories():
    """A category used on the path may be cut again only among those that came here, and never a single one."""
    from softbough.operators.search import binary_candidates

    meta = Metadata(TreeParams(max_bins=100, categories={0: 6}), 1, 1000)
    u = [np.array([[9.0, 1], [1, 9], [8, 2], [2, 8], [7, 3], [3, 7]])]
    cuts = lambda own: [c.bins for c in binary_candidates(u, u, meta, {0: own} if own else {}, 1.0)]
    assert cuts(None) == [(0,), (0, 2), (0, 2, 4), (0, 2, 4, 1), (0, 2, 4, 1, 3)]
    assert cuts({0, 2, 4}) == [(0,), (0, 2), (0, 2, 4)] and cuts({4}) == []


def test_reservoir(spark):
    from softbough.sources.readers import reservoir_sample

    df = spark.range(100)
    got = [r.id for r in reservoir_sample(df, 30, 3, F.col("id") % 2 == 0).collect()]
    assert len(set(got)) == 30 and all(i % 2 for i in got)
    assert reservoir_sample(df, 500).count() == 100


def test_libsvm(spark, tmp_path):
    from softbough.sources.readers import read_libsvm

    (tmp_path / "x.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    df, names = read_libsvm(spark, str(tmp_path / "x.txt"), 3)
    assert names == ["f0", "f1", "f2"] and sorted(map(tuple, df.collect())) == [(0, 0.0, 1.0, 0.0), (1, 0.5, 0.0, 2.0)]


@pytest.mark.parametrize("split", ["binary_split", "multi_split"])
def test_groups_of_nodes(spark, split, monkeypatch):
    """Nodes in several groups a level give the same tree as all at once."""
    from softbough.operators import growth

    rows = [(int(a > 4) + int(b > 6), (float(a), float(b))) for a in range(11) for b in range(11)]
    p = TreeParams(split=split, max_depth=3, max_bins=100, num_classes=3, cores={0: [0, 5, 10], 1: [0, 3, 7, 10]})
    df = from_rows(spark, rows, ["a", "b"])
    whole = FuzzyTreeClassifier(p).fit(df, ["a", "b"], "label").debug_string()
    monkeypatch.setattr(growth, "_groups", lambda nodes, meta: [[n] for n in nodes])
    assert FuzzyTreeClassifier(p).fit(df, ["a", "b"], "label").debug_string() == whole


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(Q.SQL[name]).df()
    got = Q.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)
