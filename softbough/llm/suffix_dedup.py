"""Suffix-array dedup over sparse suffixes.

Suffixes are kept only where a k-word window has the smallest hash of its neighbourhood, so every shared passage of min_words words
has a kept suffix at the same place in both copies. Suffixes whose first k words occur once are dropped: a first pass counts
the windows' hashes, and a bitmap of the repeated ones (where they are few millions; a semi-join beyond) tells which of the second pass to keep, each with
the words around it as 16-bit hashes. These are sorted twice over the cluster, by the words to the right and by those to the left,
range partitioned on the whole key, so a passage that a third of all documents hold is dealt over many tasks. Every
suffix is compared with the nearest neighbour of another document on either side, also across partitions (whose ends
are exchanged, two rows each); the match is extended to the left and right, and where it has min_words words or more,
it is a repeated span. Spans of a document that touch are joined, so longer passages come out whole.

A match hidden from both orders by longer ones is found in a last step. The orders tell how many words to the right and how many to the left
a suffix shares with another document at most, so only windows of min_words words within that reach can be elsewhere, too. Those that the spans do not cover
yet are keyed by their words, a bitmap of those keys picks the equal windows among all suffixes (where they are many millions: all windows of suffixes
that begin with the same k words), and windows whose key two documents or more hold (counted with partial aggregation) are spans, too. So no shared passage is missed.

Words around a suffix are compared by 16 bits of their hashes, so a word that differs passes for equal in one of 65 000 cases: a match of one word
less than min_words may then count. Matches that are there are never lost by it.

Words as in the other operators (A-Z lower-cased, runs outside [\\x20\\x09-\\x0D]).
Edge cases: null, empty and short texts (fewer than min_words words) have no spans; repeats inside one document do not count; rows without doc_id
are ignored; rows that share a doc_id are one document for comparison, so their copies do not count; an empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoints, discard, n_parts, store
from ._text import _P, chunks, gram_hashes, mix, word_hashes

_MOST_BITS = 27


def _selected(raw, offs, k, span):
    """Words, their documents' begins, and the kept windows: hash and position of the first word."""
    words, begins = word_hashes(raw, offs)
    h, at = gram_hashes(words, begins, k)
    if len(h) < span:
        return words, begins, h[:0], at[:0]
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    first = np.arange(len(view))
    inside = at[first + span - 1] - at[first] == span - 1
    doc = np.searchsorted(begins, at, "right")
    inside &= doc[first + span - 1] == doc[first]
    first = first[inside]
    low = np.concatenate([view[first[a : a + 65536]].argmin(1) for a in range(0, len(first), 65536)]) if len(first) else np.zeros(0, np.int64)
    keep = np.unique(first + low)
    return words, begins, h[keep], at[keep]


def _count(k, span):
    def run(batches):
        for batch in batches:
            for _, raw, offs in chunks(batch.column("text")):
                _, _, h, _ = _selected(raw, offs, k, span)
                some, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": some.view(np.int64), "n": n.astype(np.int64)})

    return run


def _bitmap(keys: DataFrame, most: int = _MOST_BITS) -> np.ndarray | None:
    """A bitmap of the column h, with 16 bits or more for each row; None if that takes over 2**most bits."""
    bits = max(16, (16 * keys.count()).bit_length())
    if bits > most:
        return None
    bit = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(bit, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast((h & {(1 << bits) - 1}) & 31 as int))").alias("x"))
    got = words.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()  # at most 2**(most - 5) rows
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["w"].to_numpy()] = got["x"].to_numpy().astype(np.uint32)
    return out


def _hit(bits, h):
    if bits is None:
        return np.ones(h.shape, bool)
    b = h & np.uint64(32 * len(bits) - 1)
    return ((bits[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)


def _emit(k, span, side, bitmap):
    def run(batches):
        bits = bitmap.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, raw, offs in chunks(batch.column("text")):
                words, begins, h, at = _selected(raw, offs, k, span)
                hit = _hit(bits, h)
                h, at = h[hit], at[hit]
                if not len(h):
                    continue
                doc = np.searchsorted(begins, at, "right") - 1
                lo, hi = begins[doc], begins[doc + 1]
                short = ((words >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(">u2")
                step = np.arange(side)
                r = at[:, None] + k + step
                l = at[:, None] - 1 - step
                right = np.where(r < hi[:, None], short[np.minimum(r, len(words) - 1)], 0).astype(">u2")
                left = np.where(l >= lo[:, None], short[np.maximum(l, 0)], 0).astype(">u2")
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "doc_id": ids[a + doc], "pos": (at - lo).astype(np.int32), "right": pa.array([x.tobytes() for x in right], pa.binary()), "left": pa.array([x.tobytes() for x in left], pa.binary())})

    return run


_COLS = ("h", "doc_id", "pos", "right", "left")
_ENDS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("p", pa.int32()), ("side", pa.string())])


def _ends(batches):
    """The first rows of a partition's first two runs of one document, and the last rows of its last two, for its neighbours."""
    head, tail = [], []
    part = None
    for batch in batches:
        if batch.num_rows:
            part = batch.column("p")[0].as_py()
            d, h = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            edge = np.flatnonzero((d[1:] != d[:-1]) | (h[1:] != h[:-1])) + 1
            firsts = [0, *edge[:1].tolist()]
            lasts = [*(edge[-1:] - 1).tolist(), batch.num_rows - 1]
            rows = batch.take(pa.array(firsts + lasts)).select(_COLS).to_pylist()
            for r in rows[: len(firsts)]:
                if len(head) < 2 and not (head and _run(head[-1]) == _run(r)):
                    head.append(r)
            for r in rows[len(firsts) :]:
                tail = [*(tail[:-1] if tail and _run(tail[-1]) == _run(r) else tail), r][-2:]
    for side, rows in (("head", head), ("tail", tail)):
        for r in rows:
            yield pa.RecordBatch.from_pylist([r | {"p": part, "side": side}], schema=_ENDS)


def _run(row):
    return row["h"], row["doc_id"]


def _beside(lists):
    """The first two runs of several partitions' ends."""
    out: list = []
    for r in (r for rows in lists for r in rows):
        if not out or _run(out[-1]) != _run(r):
            out.append(r)
        if len(out) == 2:
            break
    return out


def _match(k, side, min_words, ends, to_right):
    """Extends matches between neighbours of one sorted partition; rows of other partitions' ends stand at both ends. Also how many words
    each suffix (begin; no end) shares at most with another document in the direction of the order."""

    def common(x, y):
        differ = (x != y) | (x == 0)
        return np.where(differ.any(1), differ.argmax(1), side)

    def rows_of(doc, begin, end, reach):
        end, reach = (pa.nulls(len(doc), pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (end, reach))
        return pa.RecordBatch.from_pydict({"doc_id": doc, "begin": begin.astype(np.int32), "end": end, "reach": reach})

    def found(rows):
        h, d, pos, right, left = rows
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [n]]))
        reach = np.full(n, -1)
        for other in (np.repeat(begin, size) - 1, np.repeat(begin + size, size)):
            i = np.flatnonzero((other >= 0) & (other < n))
            i = i[h[other[i]] == h[i]]
            if not len(i):
                continue
            j = other[i]
            r, l = common(right[i], right[j]), common(left[i], left[j])
            reach[i] = np.maximum(reach[i], r if to_right else l)
            ok = k + r + l >= min_words
            for e in (i[ok], j[ok]):  # both ends of a match
                if len(e):
                    yield rows_of(d[e], pos[e] - l[ok], pos[e] + k + r[ok], None)
        i = np.flatnonzero(reach >= 0)
        if len(i):
            yield rows_of(d[i], pos[i], None, reach[i])

    def arrays(source):
        wide = lambda c: np.frombuffer(b"".join(c), ">u2").reshape(-1, side).astype(np.uint16)
        return [np.asarray(source[0], np.int64), np.asarray(source[1], np.int64), np.asarray(source[2], np.int64), wide(source[3]), wide(source[4])]

    def run(batches):
        tail = None
        after: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays([batch.column(c).to_numpy() if c in _COLS[:3] else batch.column(c).to_pylist() for c in _COLS])
            if tail is None:
                before, after = ends.value.get(batch.column("p")[0].as_py(), ([], []))
                tail = arrays(list(zip(*([r[c] for c in _COLS] for r in before)))) if before else None
            if tail is not None:
                rows = [np.concatenate([t, x]) for t, x in zip(tail, rows)]
            yield from found(rows)
            # keep the last document's rows and one row before them
            h, d = rows[0], rows[1]
            same = np.flatnonzero((h != h[-1]) | (d != d[-1]))
            cut = int(same[-1]) if len(same) else 0
            tail = [x[cut:] for x in rows]
        if tail is not None and after:
            more = arrays(list(zip(*([r[c] for c in _COLS] for r in after))))
            yield from found([np.concatenate([t, x]) for t, x in zip(tail, more)])

    return run


def _neighbours(kept: DataFrame, key: list[str], k, side, min_words) -> DataFrame:
    spark = kept.sparkSession
    checkpoints(spark)
    order = ["h", *key, "doc_id"]
    dealt = kept.repartitionByRange(n_parts(spark), *order).sortWithinPartitions(*order, "pos").withColumn("p", F.spark_partition_id()).checkpoint()
    rows = dealt.mapInArrow(_ends, "h long, doc_id long, pos int, right binary, left binary, p int, side string").collect()  # at most four a partition
    by: dict = {}
    for r in rows:
        by.setdefault(r.p, {"head": [], "tail": []})[r.side].append(r)
    parts, ends = sorted(by), {}
    for i, p in enumerate(parts):  # a partition of one run leaves its neighbour's neighbour to look at
        before = _beside(by[x]["tail"][::-1] for x in parts[:i][::-1])
        ends[p] = (before[::-1], _beside(by[x]["head"] for x in parts[i + 1 :]))
    ends = {p: tuple([{c: r[c] if c in _COLS[:3] else bytes(r[c]) for c in _COLS} for r in e] for e in both) for p, both in ends.items()}
    found = dealt.mapInArrow(_match(k, side, min_words, spark.sparkContext.broadcast(ends), key[0] == "right"), "doc_id long, begin int, end int, reach int")
    return store(found, "spans")


def _window_keys(h, right, left, side):
    """For each suffix and each count of words to its left (0 .. side): the key of the window of k + side words, and whether the document holds it."""
    n = len(h)
    r, l = np.zeros((side + 1, n), np.uint64), np.zeros((side + 1, n), np.uint64)
    for j in range(side):
        r[j + 1] = (r[j] + right[:, j]) * np.uint64(_P)
        l[j + 1] = (l[j] + left[:, j]) * np.uint64(_P)
    held_r = np.concatenate([np.ones((1, n), bool), np.logical_and.accumulate(right.T != 0)])
    held_l = np.concatenate([np.ones((1, n), bool), np.logical_and.accumulate(left.T != 0)])
    count = np.arange(side + 1, dtype=np.uint64)[:, None]
    return mix(mix(l + h) + r[::-1] + count), held_l & held_r[::-1]


def _words_of(column, side):
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, side).astype(np.uint64)


def _open(k, side):
    """Suffixes with windows within reach that no span covers, as bits by the words to the left; rows are suffixes and joined spans, sorted by document, position, spans first."""

    def run(batches):
        last = (-1, -1, -1)  # document, begin and end of the span before
        for batch in batches:
            if not batch.num_rows:
                continue
            d, pos, end, r, l = (batch.column(c).to_numpy() for c in ("doc_id", "pos", "end", "r", "l"))
            span = end >= 0
            d, pos, end, span = (np.concatenate([[x], y]) for x, y in zip((*last, True), (d, pos, end, span)))
            at = np.maximum.accumulate(np.where(span, np.arange(len(d)), 0))
            last = (d[at[-1]], pos[at[-1]], end[at[-1]])
            i = np.flatnonzero(~span)
            near, words = at[i], np.arange(side + 1)[:, None]
            begin = pos[i] - words
            covered = (d[near] == d[i]) & (pos[near] <= begin) & (end[near] >= begin + k + side)
            free = ~covered & (words <= l[i - 1]) & (side - words <= r[i - 1])
            some = free.any(0)
            bits = (free.astype(np.int64) << words).sum(0)
            if some.any():
                yield pa.RecordBatch.from_pydict({"doc_id": d[i[some]], "pos": pos[i[some]].astype(np.int32), "windows": bits[some]})

    return run


def _picked(bitmap):
    def run(batches):
        bits = bitmap.value
        for batch in batches:
            keep = np.flatnonzero(_hit(bits, batch.column("at").to_numpy().view(np.uint64)))
            if len(keep):
                yield batch.select(_COLS).take(pa.array(keep))

    return run


def _rest(side):
    """The open windows of suffixes."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                key, held = _window_keys(part.column("h").to_numpy().view(np.uint64), _words_of(part.column("right"), side), _words_of(part.column("left"), side), side)
                x, y = np.nonzero(held & (part.column("windows").to_numpy() >> np.arange(side + 1)[:, None] & 1).astype(bool))
                if len(x):
                    h, d, pos = (part.column(c).to_numpy()[y] for c in _COLS[:3])
                    yield pa.RecordBatch.from_pydict({"key": key[x, y].view(np.int64), "doc_id": d, "begin": (pos - x).astype(np.int32), "h": h})

    return run


def _same_windows(side, bitmap):
    """(key, doc_id) of all suffixes' windows whose key the bitmap holds."""

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                key, held = _window_keys(part.column("h").to_numpy().view(np.uint64), _words_of(part.column("right"), side), _words_of(part.column("left"), side), side)
                x, y = np.nonzero(held & _hit(bits, key))
                if len(x):
                    yield pa.RecordBatch.from_pydict({"key": key[x, y].view(np.int64), "doc_id": part.column("doc_id").to_numpy()[y]})

    return run


def _hidden(kept: DataFrame, joined: DataFrame, right: DataFrame, left: DataFrame, k, side) -> DataFrame:
    """(doc_id, begin, end) of the repeated windows that the joined spans do not cover."""
    spark = kept.sparkSession
    none = F.lit(None).cast("int")
    spans = joined.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.begin").alias("pos"), F.col("s.end").alias("end"), F.lit(-1).alias("r"), F.lit(-1).alias("l"))
    given = [t.where("reach is not null").select("doc_id", F.col("begin").alias("pos"), r.alias("r"), l.alias("l")) for t, r, l in ((right, F.col("reach"), none), (left, none, F.col("reach")))]
    reach = given[0].unionByName(given[1]).groupBy("doc_id", "pos").agg(F.max("r").alias("r"), F.max("l").alias("l")).where(F.col("r") + F.col("l") >= side)
    rows = reach.withColumn("end", F.lit(-1)).unionByName(spans).repartition(n_parts(spark), "doc_id").sortWithinPartitions("doc_id", "pos", F.col("end").desc())
    open_ = store(rows.mapInArrow(_open(k, side), "doc_id long, pos int, windows long"), "open")
    at = F.xxhash64("doc_id", "pos")
    bits = _bitmap(open_.select(at.alias("h")))
    some = kept.withColumn("at", at).mapInArrow(_picked(spark.sparkContext.broadcast(bits)), kept.schema) if bits is not None else kept
    rest = store(some.join(open_, ["doc_id", "pos"]).mapInArrow(_rest(side), "key long, doc_id long, begin int, h long"), "rest")
    bits = _bitmap(rest.select(F.col("key").alias("h")))
    some = kept if bits is not None else kept.join(rest.select("h").distinct(), "h", "left_semi")
    same = some.mapInArrow(_same_windows(side, spark.sparkContext.broadcast(bits)), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    found = store(rest.join(same.select("key"), "key").select("doc_id", "begin", (F.col("begin") + k + side).alias("end")).distinct(), "hidden")
    discard(rest)
    discard(open_)
    return found


def _join_spans(batches):
    for batch in batches:
        spans, words = [], []
        for s in batch.column("spans").to_pylist():
            out: list = []
            for x in sorted((x["begin"], x["end"]) for x in s):
                if out and x[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], x[1])
                else:
                    out.append(list(x))
            spans.append([{"begin": a, "end": b} for a, b in out])
            words.append(sum(b - a for a, b in out))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_spans": pa.array([len(s) for s in spans], pa.int32()), "n_words": pa.array(words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))})


def repeated_spans(docs: DataFrame, min_words: int = 50, k: int = 20) -> DataFrame:
    """(doc_id, n_spans, n_words, spans) of each document that shares a passage of min_words words or more with another; spans in words."""
    spark = docs.sparkSession
    span, side = min_words - k + 1, min_words - k
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    seen = docs.select("text").mapInArrow(_count(k, span), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    seen = store(seen.select("h"), "repeated")
    bits = _bitmap(seen)
    suffixes = docs.mapInArrow(_emit(k, span, side, spark.sparkContext.broadcast(bits)), "h long, doc_id long, pos int, right binary, left binary")
    kept = store(suffixes if bits is not None else suffixes.join(seen, "h", "left_semi"), "suffixes")
    discard(seen)
    spans = [_neighbours(kept, key, k, side, min_words) for key in (["right", "left"], ["left", "right"])]
    joined = "doc_id long, n_spans int, n_words long, spans array<struct<begin:int,end:int>>"

    def by_document(found):
        return found.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).mapInArrow(_join_spans, joined)

    matches = spans[0].unionByName(spans[1]).where("end is not null").select("doc_id", "begin", "end")
    first = store(by_document(matches), "joined")
    hidden = _hidden(kept, first, *spans, k, side)
    for t in (*spans, kept):
        discard(t)
    whole = first.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.begin", "s.end")
    return by_document(whole.unionByName(hidden))
