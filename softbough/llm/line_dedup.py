"""Line dedup: range-partitioned line hashes with a secondary sort by document and position.

Each sufficiently long line gives a record (hash, document, position). The records are range
partitioned on (hash, document), so a line that a third of all documents hold is dealt over
many partitions; a summary of each partition's first and last run, one row per partition,
tells what the neighbours hold. Each partition is then streamed in order: the line's first
document in the order stays, the others' records become entries of compressed per-document keep
bitmaps. No text is shuffled until the bitmaps meet the documents.

A line is what stands between newlines (null or empty text: one empty line). Its key is the line
without white space [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased. Edge cases: a document that holds a key several
times counts once and keeps or loses all of them; rows without doc_id are ignored; several rows with one doc_id count as
one document, but each row is cut by its own lines; an empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoints, discard, lean, n_parts, store

WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _keys(text: bytes, min_chars: int):
    """(position, key) of the lines that can be dropped."""
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(WHITE)
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                yield i, key.translate(_LOWER)


def _bytes(column):
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _scan(min_chars):
    def run(batches):
        for batch in batches:
            h, docs, prints, at = [], [], [], []
            for doc, x, text in zip(batch.column("doc_id").to_pylist(), batch.column("x").to_pylist(), _bytes(batch.column("text"))):
                for i, key in _keys(text, min_chars):
                    h.append(hashlib.blake2b(key, digest_size=16).digest())
                    docs.append(doc)
                    prints.append(x)
                    at.append(i)
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"h1": both[:, 0], "h2": both[:, 1], "doc_id": pa.array(docs, pa.int64()), "x": pa.array(prints, pa.int64()), "pos": pa.array(at, pa.int32())})

    return run


_COLS = ("h1", "h2", "doc_id", "x", "pos")


def _runs(h1, h2):
    cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(h1)]]).astype(np.int64)


def _edges(batches):
    """Documents (and the largest) of the first and of the last key of one sorted partition."""
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, d = (batch.column(c).to_numpy() for c in _COLS[:3])
        begin, end = _runs(h1, h2)
        for b, e in {(begin[0], end[0]): 0, (begin[-1], end[-1]): 0}:
            key, n = (int(h1[b]), int(h2[b])), 1 + int((d[b + 1 : e] != d[b : e - 1]).sum())
            if last and last[0] == key:
                last[1] += n - int(d[b] == last[3])
                last[3] = int(d[e - 1])
            else:
                last = [key, n, int(d[b]), int(d[e - 1])]
                first = first or last
    for key, n, top, _ in [first] * (first is not None) + [last] * (last is not first):
        yield pa.RecordBatch.from_pydict({"h1": [key[0]], "h2": [key[1]], "n": [n], "top": [top]})


def _stream(min_docs, across):
    """Streams sorted records and yields those to drop; a key at a partition's edge has its totals in `across`."""

    def run(batches):
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in _COLS]
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
            begin, _ = _runs(*cols[:2])
            yield from decide([c[: begin[-1]] for c in cols])
            tail = [c[begin[-1] :] for c in cols]
            if (int(tail[0][0]), int(tail[1][0])) in across.value:  # no need to see its end
                yield from decide(tail)
                tail = None
        if tail is not None:
            yield from decide(tail)

    def decide(cols):
        h1, h2, d, x, pos = cols
        if not len(d):
            return
        begin, end = _runs(h1, h2)
        new = np.ones(len(d), np.int64)
        new[1:] = d[1:] != d[:-1]
        new[begin] = 1
        n, top = np.add.reduceat(new, begin), d[begin].copy()
        for i in {0, len(begin) - 1}:
            if (known := across.value.get((int(h1[begin[i]]), int(h2[begin[i]])))) is not None:
                n[i], top[i] = known
        lose = (np.repeat(n, end - begin) >= min_docs) & (np.repeat(top, end - begin) != d)
        if lose.any():
            yield pa.RecordBatch.from_pydict({"doc_id": d[lose], "x": x[lose], "pos": pos[lose]})

    return run


def _pack(batches):
    for batch in batches:
        maps = []
        for at in batch.column("at"):
            at = at.values.to_numpy()
            keep = np.ones(at.max() + 1, np.uint8)
            keep[at] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes() + bytes([(-len(keep)) % 8]), 1))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": batch.column("x"), "keep": pa.array(maps, pa.binary())})


def unpack_bitmap(keep: bytes) -> np.ndarray:
    """Flags of the lines up to the last one dropped; all further lines stay."""
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw, np.uint8, len(raw) - 1))[: 8 * (len(raw) - 1) - raw[-1]].astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, x, keep) for the documents that lose a line; x is xxhash64 of the text, keep a bitmap for unpack_bitmap()."""
    spark = docs.sparkSession
    given = docs.where("doc_id is not null").select("doc_id", "text", F.expr("xxhash64(coalesce(text, ''))").alias("x"))
    lines = store(given.mapInArrow(lean(_scan(min_chars)), "h1 long, h2 long, doc_id long, x long, pos int"), "lines")
    parts = max(n_parts(spark), 1)
    order = ["h1", "h2", F.desc("doc_id")]
    checkpoints(spark)
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "x", "pos").checkpoint()
    edges = dealt.mapInArrow(lean(_edges), "h1 long, h2 long, n long, top long").collect()  # two rows a partition at most
    across: dict = {}
    for e in edges:
        n, top = across.get((e.h1, e.h2), (0, e.top))
        across[e.h1, e.h2] = (n + e.n, max(top, e.top))
    lost = dealt.mapInArrow(lean(_stream(min_docs, spark.sparkContext.broadcast(across))), "doc_id long, x long, pos int")
    grouped = lost.groupBy("doc_id", "x").agg(F.collect_set("pos").alias("at"))
    out = store(grouped.mapInArrow(lean(_pack), "doc_id long, x long, keep binary"), "bitmaps")
    discard(lines)
    return out


def _apply(names, bitmap):
    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column(bitmap).to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                n_dropped.append(0)
                if keep is not None:
                    flags = unpack_bitmap(keep)
                    stay = [x for i, x in enumerate(lines) if i >= len(flags) or flags[i]]
                    n_dropped[-1] = len(lines) - len(stay)
                    text = "\n".join(stay)
                texts.append(text)
            cols = {c: batch.column(c) for c in names}
            cols |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the repeated lines taken out of text, plus n_lines (before) and n_dropped; columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_dropped")
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name, so it clashes with none
    doc, x, keep = free + "doc", free + "x", free + "keep"
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("x").alias(x), F.col("keep").alias(keep))
    on = (docs["doc_id"] == maps[doc]) & (F.expr("xxhash64(coalesce(text, ''))") == maps[x])
    joined = docs.join(maps.hint("shuffle_hash"), on, "left").drop(doc, x)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(lean(_apply(docs.columns, keep)), schema)
