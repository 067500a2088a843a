"""The trained tree: scoring, metrics, text."""
from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tnorms import tnorm as tnorm_by_name
from ..plans.params import Metadata, TreeParams


@dataclass
class Node:
    node_id: int
    level: int
    history: dict = field(default_factory=dict)
    parent: int | None = None
    value_index: int | None = None  # the bin that leads to a child of a multi-way split
    is_leaf: bool = True
    feature: int | None = None
    left_bins: tuple = ()
    gain: float | None = None
    impurity: float = -1.0
    u: np.ndarray | None = None
    f: np.ndarray | None = None
    children: list = field(default_factory=list)

    def weights(self) -> list[float]:
        total = float(self.u.sum())
        return [float(x) / total if total > 0 else 0.0 for x in self.u]

    def frequencies(self) -> list[float]:
        total = float(self.f.sum())
        return [float(x) / total if total > 0 else 0.0 for x in self.f]

    def is_mono_label(self) -> bool:
        return int((self.f > 0).sum()) == 1

    def purity(self) -> float:
        total = float(self.u.sum())
        return float(self.u.max()) / total if total > 0 else float("nan")


class FuzzyTreeModel:
    def __init__(self, meta: Metadata, nodes: dict[int, Node], features: list[str]):
        self.meta, self.nodes, self.features = meta, nodes, features

    # scoring ---------------------------------------------------------------------------------------------------------
    def paths(self, columns: list[Column], tnorm) -> list[tuple[Column, Column, list[float]]]:
        """(condition, degree, class weights) of every way to a leaf, as Column expressions."""
        out, meta = [], self.meta

        def multi(node, degree, cond):
            if node.is_leaf:
                out.append((cond, degree, node.weights()))
                return
            for kid in map(self.nodes.get, node.children):
                mu = meta.sets[node.feature][kid.value_index].membership(columns[node.feature])
                multi(kid, tnorm.column(degree, mu), cond & (mu != 0))

        def binary(node, degree, cond, hist):
            if node.is_leaf:
                out.append((cond, degree, node.weights()))
                return
            f, (left, right) = node.feature, map(self.nodes.get, node.children)
            mus = [(b, meta.sets[f][b].membership(columns[f])) for b in node.left_bins]
            s = sum((m for _, m in mus), F.lit(0.0))
            was = hist.get(f)
            if was is not None and was != -1:
                binary(left if was in node.left_bins else right, degree, cond, hist)
                return
            # the side's last fired set, by which later splits on f are decided
            lasts = []
            for i, (b, mu) in enumerate(mus):
                later = F.lit(True)
                for _, m in mus[i + 1 :]:
                    later = later & (m <= 0)
                lasts.append((b, (mu > 0) & later))
            if was is None:
                binary(left, tnorm.column(degree, s), cond & (s == 1.0), hist)
                for b, last in lasts:
                    binary(left, tnorm.column(degree, s), cond & (s > 0) & (s != 1.0) & last, {**hist, f: b})
                binary(right, tnorm.column(degree, F.lit(1.0) - s), cond & (s > 0) & (s != 1.0), {**hist, f: -1})
                binary(right, tnorm.column(degree, F.lit(1.0)), cond & (s <= 0), hist)
            else:
                for b, last in lasts:
                    binary(left, degree, cond & (s > 0) & last, {**hist, f: b})
                binary(right, degree, cond & (s <= 0), hist)

        if meta.params.binary:
            binary(self.nodes[1], F.lit(1.0), F.lit(True), {})
        else:
            multi(self.nodes[1], F.lit(1.0), F.lit(True))
        return out

    def path_count(self, limit: int) -> int:
        """How many entries paths() would have; counting stops beyond limit."""
        binary, left = self.meta.params.binary, [limit]

        def count(node, hist):
            if left[0] < 0:
                return
            if node.is_leaf:
                left[0] -= 1
                return
            kids = [self.nodes[c] for c in node.children]
            if not binary:
                for k in kids:
                    count(k, hist)
                return
            f, was = node.feature, hist.get(node.feature)
            if was is not None and was != -1:
                count(kids[0] if was in node.left_bins else kids[1], hist)
                return
            if was is None:
                count(kids[0], hist)
                count(kids[1], {**hist, f: -1})
            for b in node.left_bins:
                count(kids[0], {**hist, f: b})
            count(kids[1], hist)

        count(self.nodes[1], {})
        return limit - left[0]

    def walk(self, x: np.ndarray, tnorm) -> tuple[np.ndarray, np.ndarray]:
        """Confidences rows x classes of a matrix of feature values, and which rows reach a leaf; recursion over nodes, each with its rows."""
        meta, out = self.meta, np.zeros((len(x), self.meta.params.num_classes))
        arrived = np.zeros(len(x), bool)
        mu: dict = {}

        def degrees(f, b):
            if (f, b) not in mu:
                s, v = meta.sets[f][b], x[:, f]
                if hasattr(s, "a") and (s.a is not None or s.c is not None):
                    rise = np.ones(len(v)) if s.a is None else (v - s.a) / (s.b - s.a)
                    fall = np.ones(len(v)) if s.c is None else 1.0 - (v - s.b) / (s.c - s.b)
                    m = np.where(v <= s.b, rise, fall)
                    m[(v <= s.a) if s.a is not None else np.zeros(len(v), bool)] = 0
                    m[(v >= s.c) if s.c is not None else np.zeros(len(v), bool)] = 0
                    m[np.isnan(v)] = 0
                else:
                    m = (v == s.b).astype(float)
                mu[f, b] = m
            return mu[f, b]

        def multi(node, rows, ad):
            if node.is_leaf:
                out[rows] += ad[:, None] * np.array(node.weights())
                arrived[rows] = True
                return
            for kid in map(self.nodes.get, node.children):
                m = degrees(node.feature, kid.value_index)[rows]
                on = m != 0
                if on.any():
                    multi(kid, rows[on], tnorm.value(ad[on], m[on]))

        def binary(node, rows, ad, hist):
            if not len(rows):
                return
            if node.is_leaf:
                out[rows] += ad[:, None] * np.array(node.weights())
                arrived[rows] = True
                return
            f, (left, right) = node.feature, map(self.nodes.get, node.children)
            was = hist.get(f)  # per row: -2 none, -1 right side, else the left side's set
            was = np.full(len(rows), -2) if was is None else was
            s, last = np.zeros(len(rows)), np.full(len(rows), -1)
            for b in node.left_bins:
                m = degrees(f, b)[rows]
                s = s + m
                last = np.where(m > 0, b, last)
            fixed = was >= 0
            in_left = np.isin(was, node.left_bins)
            new, again = was == -2, was == -1
            split = new & (s > 0) & (s != 1.0)

            def go(kid, on, degree, marks):
                binary(kid, rows[on], degree[on], {**{k: v[on] for k, v in hist.items()}, f: marks[on]})

            step = np.where(new, tnorm.value(ad, s), ad)
            go(left, (fixed & in_left) | (~fixed & (s > 0)), step, np.where(split | again, last, was))
            go(right, (fixed & ~in_left) | split | (~fixed & (s <= 0)), np.where(split, tnorm.value(ad, 1.0 - s), np.where(new, tnorm.value(ad, 1.0), ad)), np.where(split, -1, was))

        rows = np.arange(len(x))
        if meta.params.binary:
            binary(self.nodes[1], rows, np.ones(len(x)), {})
        else:
            multi(self.nodes[1], rows, np.ones(len(x)))
        return out, arrived

    def transform(self, df: DataFrame, tnorm: str | None = None, output: str = "confidences", compiled_paths: int = 40) -> DataFrame:
        """df with an array of class confidences, empty where no branch fires. A stateless projection, so it works on streams too.

        Null and NaN lie in no set: at a multi-way split they fire no branch, at a binary one the right one. Small trees are
        compiled to Column expressions, trees with more paths are walked in Arrow batches; both give the same.
        """
        t = tnorm_by_name(tnorm or self.meta.params.tnorm)
        columns = [F.col(c).cast("double") for c in self.features]
        if self.path_count(compiled_paths) <= compiled_paths:
            paths, per_class = self.paths(columns, t), []
            for k in range(self.meta.params.num_classes):
                terms = [F.when(cond, degree * F.lit(w[k])).otherwise(0.0) for cond, degree, w in paths if w[k]]
                per_class.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
            arrived = paths[0][0]
            for cond, _, _ in paths[1:]:
                arrived = arrived | cond
            return df.withColumn(output, F.when(arrived, F.array(*per_class)).otherwise(F.array().cast("array<double>")))
        import pyarrow as pa

        walk, features, names = self.walk, self.features, [c for c in df.columns if c != output]

        def run(batches):
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], 1)
                conf, arrived = walk(x, t)
                ends = np.concatenate([[0], np.cumsum(arrived * conf.shape[1])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names} | {output: pa.ListArray.from_arrays(pa.array(ends), pa.array(conf[arrived].ravel()))})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema) + f", `{output}` array<double>"
        return df.select(*names).mapInArrow(run, schema)

    def predict_class(self, df: DataFrame, tnorm: str | None = None, output: str = "prediction") -> DataFrame:
        """df with the class of largest confidence, the highest class of equal ones; -1 if no branch fires."""
        out = self.transform(df, tnorm, "__conf")
        return out.withColumn(output, argmax_class(F.col("__conf"))).drop("__conf")

    def predict_row(self, values, tnorm: str | None = None) -> dict[int, float]:
        """class -> confidence of one row; empty if no branch fires."""
        got, arrived = self.walk(np.array([values], float), tnorm_by_name(tnorm or self.meta.params.tnorm))
        return dict(enumerate(got[0].tolist())) if arrived[0] else {}

    def copy(self) -> FuzzyTreeModel:
        """A model whose nodes are its own."""
        return FuzzyTreeModel(self.meta, deepcopy(self.nodes), list(self.features))

    # metrics ---------------------------------------------------------------------------------------------------------
    def _live(self):
        """Nodes that count: all of a binary tree, those of a multi-way tree with rows (and its root)."""
        return [n for n in self.nodes.values() if self.meta.params.binary or n.node_id == 1 or float(n.f.sum()) > 0]

    @property
    def num_nodes(self) -> int:
        return len(self._live())

    @property
    def num_leaves(self) -> int:
        return sum(n.is_leaf and float(n.f.sum()) > 0 for n in self.nodes.values())

    @property
    def depth(self) -> int:
        return max(n.level for n in self.nodes.values())

    @property
    def min_depth(self) -> int:
        return min(n.level for n in self.nodes.values() if n.is_leaf)

    @property
    def average_depth(self) -> float:
        """Mean level of leaves; of a multi-way tree, that of the first leaf with rows below each child of the root."""
        if self.meta.params.binary or self.nodes[1].is_leaf:
            levels = [n.level for n in self.nodes.values() if n.is_leaf]
        else:
            def first(n):
                if n.is_leaf:
                    return n.level if float(n.f.sum()) > 0 else None
                return next((d for d in map(first, map(self.nodes.get, n.children)) if d is not None), None)

            levels = [d for d in map(first, map(self.nodes.get, self.nodes[1].children)) if d is not None]
        return sum(levels) / len(levels) if levels else 0.0

    @property
    def average_depth_all(self) -> float:
        levels = [n.level for n in self.nodes.values() if n.is_leaf]
        return sum(levels) / len(levels)

    def max_id(self, node_id: int = 1) -> int:
        return max([node_id, *map(self.max_id, self.nodes[node_id].children)])

    def subtree(self, node_id: int = 1):
        """Depth-first iteration."""
        yield self.nodes[node_id]
        for c in self.nodes[node_id].children:
            yield from self.subtree(c)

    def debug_string(self) -> str:
        kind = "binary" if self.meta.params.binary else "multi-way"
        lines = [f"Fuzzy tree ({kind}) of depth {self.depth} with {self.num_nodes} nodes and {self.num_leaves} leaves"]

        def show(n, indent):
            pad = "¦   " * indent
            if n.is_leaf:
                lines.append(f"{pad}Predict: " + ", ".join(f"{c}: {w:.6g}" for c, w in enumerate(n.weights())))
            elif self.meta.params.binary:
                for word, no, kid in (("If", "", n.children[0]), ("Else", "not ", n.children[1])):
                    lines.append(f"{pad}{word} {self.features[n.feature]} {no}in {sorted(n.left_bins)}")
                    show(self.nodes[kid], indent + 1)
            else:
                for kid in map(self.nodes.get, n.children):
                    if float(kid.f.sum()) > 0:
                        lines.append(f"{pad}{self.features[n.feature]} = {kid.value_index}")
                        show(kid, indent + 1)

        show(self.nodes[1], 1)
        return "\n".join(lines)

    # tables ----------------------------------------------------------------------------------------------------------
    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.node_id, n.parent, n.level, n.is_leaf, n.feature, [int(b) for b in n.left_bins], n.value_index, None if n.gain is None else float(n.gain), float(n.impurity), [float(v) for v in n.u], [float(v) for v in n.f], list(n.children), json.dumps({k: None if v is None else sorted(v) for k, v in n.history.items()})) for n in self.nodes.values()]
        return spark.createDataFrame(rows, "node_id long, parent long, level int, is_leaf boolean, feature int, bins array<int>, value_index int, gain double, impurity double, u array<double>, f array<double>, children array<long>, history string")

    def fuzzy_set_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.meta.value_id(f, i), f, i, type(s).__name__.lower(), s.a, s.b, s.c) for f, sets in enumerate(self.meta.sets) for i, s in enumerate(sets)]
        return spark.createDataFrame(rows, "value_id int, feature int, idx int, kind string, a double, b double, c double")

    def save(self, spark: SparkSession, path: str) -> None:
        from dataclasses import asdict

        p = asdict(self.meta.params)
        about = json.dumps({"params": {k: ({str(i): x for i, x in v.items()} if isinstance(v, dict) else v) for k, v in p.items()}, "features": self.features, "num_examples": self.meta.num_examples})
        self.node_table(spark).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FuzzyTreeModel:
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        p = about["params"]
        p |= {k: {int(i): x for i, x in p[k].items()} for k in ("categories", "cores")}
        nodes = {}
        for r in spark.read.parquet(f"{path}/nodes").collect():
            history = {int(k): None if v is None else set(v) for k, v in json.loads(r.history).items()}
            nodes[r.node_id] = Node(r.node_id, r.level, history, r.parent, r.value_index, r.is_leaf, r.feature, tuple(r.bins), r.gain, r.impurity, np.array(r.u), np.array(r.f), list(r.children))
        return cls(Metadata(TreeParams(**p), len(about["features"]), about["num_examples"]), nodes, about["features"])


def argmax_class(confidences: Column) -> Column:
    """The highest class of largest confidence; -1 for an empty array."""
    pairs = F.transform(confidences, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.coalesce(F.array_max(pairs)["i"], F.lit(-1))


def error_rate(df: DataFrame, label: str, prediction: str) -> DataFrame:
    wrong = (F.col(label) != F.col(prediction)).cast("double")
    return df.agg(F.avg(wrong).alias("error_rate"), (1 - F.avg(wrong)).alias("accuracy"), F.count("*").alias("n"))


def merge_confidences(a: Column, b: Column) -> Column:
    """Sum of two class -> confidence maps; a class absent from one counts 0 there."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
