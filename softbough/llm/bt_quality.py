"""Quality classifier: Bradley-Terry ranking on pairs of documents.

A document's features are whole-text statistics (character classes, words, lines, repetition), 28 in all, none hashed.
Preference pairs join each labelled good document with bad ones; a logistic loss on feature differences
gives weights, so that w.x ranks documents. The rank score is then put on a 0-1 scale by a monotone logistic fit on the same rows,
and the model's threshold is the quantile of the fitted rows' scores at their share of label 0 (halfway between the two rows there). The
pipeline cuts at it; the query cuts at 0.3, as its contract says.

Every labelled row takes part in the fit, the scale and the threshold. Rows are dealt into buckets of about BUCKET by the hash of doc_id, and each row
is paired PAIRS times or more within its bucket (rows of a rare class are copied to several buckets for that). A step of Newton's method
is one pass over the buckets; a few thousand numbers of each reach the driver, which adds them in the order of the buckets. Scoring takes in
every whole text and is one narrow pass.

Edge cases: a null text is an empty one and has a score; labels that are null, repeated (largest counts)
or of unknown documents are allowed; with only one class among the labels, all scores are the class's share; an empty table gives no rows. Columns other than doc_id and text are never features.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, lean, n_parts, store
from ._text import chunks, word_hashes

N_FEATURES = 28
BUCKET = 8192
CHUNK = 1 << 19  # bytes of text at once: counting takes about thirty times as much
PAIRS = 5
_RARE = 64  # rows of the rarer class in a bucket, about, at least
_FEW = 1 << 16  # scores that the driver may hold


def _class_table() -> np.ndarray:
    """Byte -> class: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence end, 7 inner punctuation, 8 symbol, 9 UTF-8 head, 10 UTF-8 tail."""
    t = np.zeros(256, np.uint8)
    t[97:123], t[65:91], t[48:58], t[32], t[10] = 1, 2, 3, 4, 5
    for c in b".?":
        t[c] = 6
    for c in b",;:'\"-()":
        t[c] = 7
    for c in b"!#$%&*+/<=>@[\\]^_`{|}~":
        t[c] = 8
    t[128:192], t[192:] = 10, 9
    return t


def features(raw, offs) -> np.ndarray:
    """One row of N_FEATURES numbers for each document of a chunk, in float64."""
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    out = np.zeros((n, N_FEATURES))
    out[:, 0] = np.log1p(size)
    if not len(raw):
        return out
    cls = _class_table()[raw]
    owner = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(owner * 11 + cls, minlength=11 * n).reshape(n, 11).astype(np.float64)
    length = np.maximum(size, 1)
    out[:, 1:12] = counts / length[:, None]
    words, begins = word_hashes(raw, offs)
    nw = np.diff(begins).astype(np.float64)
    w = np.maximum(nw, 1)
    out[:, 12] = np.log1p(nw)
    out[:, 13] = (size - counts[:, 4] - counts[:, 5]) / w
    lines = counts[:, 5] + 1
    out[:, 14] = np.log1p(nw / lines)
    out[:, 15] = counts[:, 8] / w
    out[:, 16] = counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1)
    out[:, 17] = counts[:, 6] / w
    word_owner = np.repeat(np.arange(n), np.diff(begins))
    order = np.lexsort((words, word_owner))
    so, sw = word_owner[order], words[order]
    new = np.ones(len(so), bool)
    new[1:] = (so[1:] != so[:-1]) | (sw[1:] != sw[:-1])
    distinct = np.bincount(so[new], minlength=n)
    out[:, 18] = distinct / w
    out[:, 19] = distinct / np.sqrt(w)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    out[:, 20] = np.bincount(word_owner[same], minlength=n) / w
    top = np.zeros(n)
    begin = np.flatnonzero(new)
    if len(begin):
        np.maximum.at(top, so[begin], np.diff(np.concatenate([begin, [len(so)]])))
    out[:, 21] = top / w
    # pairs of bytes that tell word shapes: symbol or capital runs, symbol after a letter, punctuation before a space
    a, b, inside = cls[:-1], cls[1:], owner[1:] == owner[:-1]
    for k, pair in enumerate(((a == 8) & (b == 8), (a == 2) & (b == 2), (a == 1) & (b == 8), (a == 8) & (b == 4), (a == 4) & (b == 8), (a == 3) & (b == 3))):
        out[:, 22 + k] = np.bincount(owner[1:][pair & inside], minlength=n) / w
    return out


@dataclass(frozen=True)
class PairwiseModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    threshold: float = 0.0  # without both classes all rows are kept

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))


def _widen(x: np.ndarray) -> np.ndarray:
    """Square roots of the shares beside the shares: small amounts of junk tell much."""
    return np.concatenate([x, np.sqrt(np.abs(x[:, 1:]))], 1)


def _sigmoid(m):
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def _moments(x, y, own):
    """Rows, good and bad ones, sum of labels; the features' means and squares about them."""
    x, y = x[own], y[own]
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    return np.concatenate([[len(y), (y == 1).sum(), (y == 0).sum(), y.sum()], mean, ((x - mean) ** 2).sum(0)])


def _preferences(mean, scale, w, seed):
    """Pairs, their loss, its gradient and second derivatives at w. Each row of a bucket is in PAIRS pairs or more."""

    def sums(x, y, own):
        z = np.clip((x - mean) / scale, -8, 8)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        n, f = max(len(good), len(bad)), len(w)
        out = np.zeros(2 + f + f * f)
        if not len(good) or not len(bad):
            return out
        rng, at = np.random.default_rng(seed), np.arange(n)
        for _ in range(PAIRS):
            d = z[rng.permutation(good)[at % len(good)]] - z[rng.permutation(bad)[at % len(bad)]]
            m = d @ w
            p = _sigmoid(-m)
            out[0] += n
            out[1] += np.logaddexp(0, -m).sum()
            out[2 : 2 + f] -= p @ d
            out[2 + f :] += ((d * (p * (1 - p))[:, None]).T @ d).ravel()
        return out

    return sums


def _scaling(mean, scale, w, a, b):
    """Loss of label = logistic(a s + b), its gradient and second derivatives."""

    def sums(x, y, own):
        s, y = np.clip((x[own] - mean) / scale, -8, 8) @ w, y[own]
        p = _sigmoid(a * s + b)
        q = p * (1 - p)
        loss = (np.logaddexp(0, a * s + b) - y * (a * s + b)).sum()
        return np.array([loss, ((p - y) * s).sum(), (p - y).sum(), (q * s * s).sum(), (q * s).sum(), (q * s).sum(), q.sum()])

    return sums


def _binned(model, depth, at):
    """How many scores lie in each 1024th of bin `at` of 2**depth."""

    def sums(x, y, own):
        s = model.score(x[own])
        s = np.minimum(np.floor(s * 2.0 ** (depth + 10)), 2.0 ** (depth + 10) - 1).astype(np.int64) - at * 1024
        return np.bincount(s[(s >= 0) & (s < 1024)], minlength=1024).astype(np.float64)

    return sums


def _within(model, depth, at):
    """The least score above bin `at` of 2**depth, the distinct scores in it, and how often they come."""

    def sums(x, y, own):
        s = model.score(x[own])
        i = np.minimum(np.floor(s * 2.0**depth), 2.0**depth - 1)
        return np.concatenate([[s[i > at].min(initial=np.inf)], *np.unique(s[i == at], return_counts=True)])

    return sums


def _halfway(ask, model, rank: int, n: int) -> float:
    """Halfway between the scores of places rank and rank + 1, counted from 1: exact, by counts in ever narrower bins."""
    depth, at, below, inside = 0, 0, 0, n
    while inside > _FEW and depth < 50:
        counts = sum(ask(_binned(model, depth, at))).astype(np.int64)
        upto = below + np.cumsum(counts)
        i = int(np.searchsorted(upto, rank))
        below, inside, depth, at = int(upto[i] - counts[i]), int(counts[i]), depth + 10, at * 1024 + i
    got = ask(_within(model, depth, at))
    scores = np.concatenate([x[1 : 1 + len(x) // 2] for x in got])
    order = np.argsort(scores)
    upto = below + np.cumsum(np.concatenate([x[1 + len(x) // 2 :] for x in got])[order])
    i, j = np.searchsorted(upto, [rank, rank + 1])
    return float((scores[order][i] + (scores[order][j] if j < len(order) else min(x[0] for x in got))) / 2)


def _newton(at, v: np.ndarray, steps: int = 50) -> np.ndarray:
    """The least point of a convex loss; at(v) is loss, gradient and second derivatives. Steps that do not lessen the loss are halved."""
    loss, grad, hess = at(v)
    for _ in range(steps):
        step = np.linalg.solve(hess, grad)
        if grad @ step < 1e-9:
            break
        while (new := at(v - step))[0] > loss and grad @ step > 1e-12:
            step = step / 2
        v, (loss, grad, hess) = v - step, new
    return v


def _fit(ask, ridge: float, seed: int) -> PairwiseModel:
    """Newton's method for Bradley-Terry weights, then for a two-number scale; ask(f) is f(x, y, own) of each bucket of rows, own but for copies."""
    sizes = ask(_moments)
    f = (len(sizes[0]) - 4) // 2
    n, n_good, n_bad, total = sum(x[:4] for x in sizes)
    mean = sum(x[0] * x[4 : 4 + f] for x in sizes) / n
    scale = np.sqrt(sum(x[4 + f :] + x[0] * (x[4 : 4 + f] - mean) ** 2 for x in sizes) / n) + 1e-9
    if not n_good or not n_bad:
        share = float(np.clip(total / n, 1e-3, 1 - 1e-3))
        return PairwiseModel(mean, scale, np.zeros(f), 0.0, float(np.log(share / (1 - share))))

    def ranked(w):
        got = sum(ask(_preferences(mean, scale, w, seed)))
        got = got[1:] / got[0]
        return got[0] + ridge / 2 * w @ w, got[1 : 1 + f] + ridge * w, got[1 + f :].reshape(f, f) + ridge * np.eye(f)

    def scaled(v):
        got = sum(ask(_scaling(mean, scale, w, *v))) / n
        return got[0] + 5e-4 * (v[0] - 1) ** 2, got[1:3] + [1e-3 * (v[0] - 1), 0], got[3:].reshape(2, 2) + np.diag([1e-3, 1e-6])

    w = _newton(ranked, np.zeros(f))
    a, b = _newton(scaled, np.array([1.0, 0.0]))
    model = PairwiseModel(mean, scale, w, float(a), float(b))
    return replace(model, threshold=_halfway(ask, model, int(n_bad), int(n)))


def fit_pairwise(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, seed: int = 7) -> PairwiseModel:
    """The model of widened rows x with labels y, as one bucket."""
    return _fit(lambda f: [f(x, y, np.ones(len(y), bool))], ridge, seed)


def _features_of(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for a, raw, offs in chunks(batch.column("text"), CHUNK):
            x = features(raw, offs)
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(a, len(x)), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def _bucketed(batches):
    """Rows sorted by bucket -> one row for each bucket."""

    def one(bucket, held):
        cols = [b"".join(x) for x in zip(*((c.label.values.tobytes(), c.own.values.tobytes(), b"".join(c.x)) for c in held))]
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "label": pa.array([cols[0]], pa.binary()), "own": pa.array([cols[1]], pa.binary()), "x": pa.array([cols[2]], pa.binary())})

    last, held = None, []
    for batch in batches:
        for bucket, rows in batch.to_pandas().groupby("bucket"):
            if bucket != last and held:
                yield one(last, held)
                held = []
            last = bucket
            held.append(rows)
    if held:
        yield one(last, held)


def _asked(f):
    def run(batches):
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "label", "own", "x"))):
                y, own, x = (np.frombuffer(b, t) for b, t in zip(row, (np.int32, bool, np.float64)))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "out": pa.array([f(_widen(x.reshape(-1, N_FEATURES)), y, own).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", ridge: float = 1e-4, seed: int = 7) -> PairwiseModel:
    """Fits on all labelled rows of labels (doc_id, label). Only their features are shuffled and stored, for the time of the fit."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = docs.select("doc_id", "text").mapInArrow(lean(_features_of), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")
    rows = store(known.join(chosen, "doc_id").select("label", F.xxhash64("doc_id").alias("h"), "x"), "labelled")
    n, n_good, n_bad = rows.agg(F.count("*"), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n:
        discard(rows)
        return fit_pairwise(np.zeros((1, 2 * N_FEATURES - 1)), np.array([0.5]))
    buckets = -(-n // BUCKET)
    rare, rarer = min((n_good, 1), (n_bad, 0))
    copies = min(buckets, max(1, -(-_RARE * buckets // max(1, rare))))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rarer, F.lit(copies - 1)).otherwise(F.lit(0))))
    given = rows.withColumn("copy", copy).select(((F.pmod("h", F.lit(buckets)) + F.col("copy")) % buckets).cast("int").alias("bucket"), "label", (F.col("copy") == 0).alias("own"), "x")
    dealt = given.repartition(n_parts(spark), "bucket").sortWithinPartitions("bucket", "label", "own", "x")  # the same model for any order of rows
    held = store(dealt.mapInArrow(lean(_bucketed), "bucket int, label binary, own binary, x binary"), "buckets")
    discard(rows)

    def ask(f):
        with bounded_batches(spark):
            got = held.mapInArrow(lean(_asked(f)), "bucket int, out binary").toArrow()
        return [np.frombuffer(x) for _, x in sorted(zip(got["bucket"].to_pylist(), got["out"].to_pylist()))]

    model = _fit(ask, ridge, seed)
    discard(held)
    return model


def _score(model, names):
    def run(batches):
        for batch in batches:
            parts = [model.score(_widen(features(raw, offs))) for _, raw, offs in chunks(batch.column("text"), CHUNK)]
            cols = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(cols | {"score": pa.array(np.concatenate(parts) if parts else [], pa.float64())})

    return run


def score_quality(docs: DataFrame, model: PairwiseModel, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with a score of 0 to 1; a column of that name is replaced."""
    names = [c for c in (keep or docs.columns) if c != "score"]
    given = docs.select(*dict.fromkeys([*names, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", score double"
    return given.mapInArrow(lean(_score(model, names)), schema)

