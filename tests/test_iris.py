"""Known results on the iris rows."""
import pytest

from softbough.operators.growth import FuzzyTreeClassifier
from softbough.plans.params import TreeParams
from softbough.sources.readers import from_rows, read_labelled_csv
from iris_rows import ROWS

CORES = {0: [4.3, 5.2, 6.1, 7.0, 7.9], 1: [2.0, 2.6, 3.2, 3.8, 4.4], 2: [1.0, 2.475, 3.95, 5.425, 6.9], 3: [0.1, 0.7, 1.3, 1.9, 2.6]}
NAMES = ["f0", "f1", "f2", "f3"]
PROBE = [4.525, 2.9, 1.0, 1.0]


@pytest.fixture(scope="module")
def rows():
    got = [list(map(float, x.split(","))) for x in ROWS.split()]
    return [(r[-1], r[:-1]) for r in got]


def fit(spark, rows, split, tnorm="product", **more):
    p = TreeParams(split=split, tnorm=tnorm, max_depth=5, max_bins=100, num_classes=3, cores=CORES, **more)
    return FuzzyTreeClassifier(p).fit(from_rows(spark, rows[:135], NAMES), NAMES, "label")


@pytest.mark.parametrize("split, expected", [
    ("binary_split", {("product", 0): [0.999995192184415, 4.807815585015025e-6, 0], ("min", 0): [0.999995192184415, 4.807815585015025e-6, 0], ("product", 1): [0.4010511345, 0.59894886550, 0], ("min", 1): [0.9210316104, 1.3289683896, 0]}),
    ("multi_split", {("product", 0): [0.9999955236, 4.476353383e-6, 0], ("min", 0): [1.3332838137, 4.951965931e-5, 0], ("product", 1): [0.5, 0, 0], ("min", 1): [0.5, 0, 0]}),
])
def test_confidences(spark, rows, split, expected):
    model = fit(spark, rows, split)
    probes = [rows[135][1], PROBE]
    for (t, i), want in expected.items():
        assert list(model.predict_row(probes[i], t).values()) == pytest.approx(want, abs=1e-6)
        got = model.transform(from_rows(spark, [(0, probes[i])], NAMES), t).first().confidences
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("split, tnorm, train, test", [("binary_split", "product", 0.96, 0.93), ("binary_split", "min", 0.96, 0.93), ("multi_split", "product", 0.96, 0.93), ("multi_split", "min", 0.96, 0.86)])
def test_accuracy(spark, rows, split, tnorm, train, test):
    model = fit(spark, rows, split, tnorm)
    scored = model.predict_class(from_rows(spark, rows, NAMES)).select("label", "prediction").collect()
    right = [r.label == r.prediction for r in scored]
    assert sum(right[:135]) / 135 >= train and sum(right[135:]) / 15 >= test


@pytest.mark.parametrize("least, fuzzy", [(80, 50), (50, 50)])
def test_least_rows_of_inner_nodes(spark, rows, least, fuzzy):
    model = fit(spark, rows, "binary_split", min_instances=least, min_fuzzy_instances=fuzzy)
    for n in model.nodes.values():
        assert n.is_leaf or (n.f.sum() >= least and n.u.sum() > fuzzy)


def test_labelled_csv(spark, rows, tmp_path):
    """The headerless file gives the same rows in the same types."""
    (tmp_path / "iris.csv").write_text(ROWS.strip())
    got = read_labelled_csv(spark, str(tmp_path / "iris.csv"), NAMES)
    assert dict(got.dtypes)["label"] == "int"
    assert sorted((r.label, [r[c] for c in NAMES]) for r in got.collect()) == sorted((int(y), x) for y, x in rows)
