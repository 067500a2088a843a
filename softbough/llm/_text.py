"""Vectorised word hashing over Arrow string batches.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D], with A-Z lower-cased.
Null texts are empty texts. Work is cut into chunks of whole documents, so the
memory needed follows the chunk size and the longest single document.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import process_cache

CHUNK = 2 << 20
_P, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _powers(n: int):
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    kept = process_cache()
    if len(kept.get("pow", ())) < n:
        size = max(n, CHUNK)
        power, inverse = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        kept["pow"], kept["inv"] = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return kept["pow"], kept["inv"]


def _bytes_tables():
    kept = process_cache()
    if "low" not in kept:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        ws = np.zeros(256, bool)
        ws[[9, 10, 11, 12, 13, 32]] = True
        kept["low"], kept["ws"] = low, ws
    return kept["low"], kept["ws"]


def mix(x):
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int = CHUNK):
    """Yields (first row, bytes, offsets from 0) for runs of rows of about size bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_hashes(raw, offs):
    """64-bit hash of each word, and where each document's words begin (one more entry than documents)."""
    low, ws = _bytes_tables()
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    text = low[raw]
    word = ~ws[text]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.add(text, np.uint64(1), out=total[1:], dtype=np.uint64)
    total[1:] *= power[:n]
    np.cumsum(total, out=total)
    return mix((total[e] - total[s]) * inverse[s]), np.searchsorted(s, offs).astype(np.int64)


def gram_hashes(words, begins, k: int):
    """Hash of every k-word window inside a document: (hashes, position of the first word)."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(begins[1:], np.diff(begins))
    at = np.flatnonzero(np.arange(len(words)) + k <= ends)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h + words[at + j]) * np.uint64(_P)
    return mix(h), at


def shingle_sets(raw, offs, k: int = 5):
    """Yields for each document the sorted distinct hashes of its k-word shingles.

    A document with fewer than k words, but at least one, has its whole sequence as
    its one shingle; one without words has the empty set.
    """
    words, begins = word_hashes(raw, offs)
    h, at = gram_hashes(words, begins, k)
    cut = np.searchsorted(at, begins)
    for d in range(len(offs) - 1):
        n = begins[d + 1] - begins[d]
        if n >= k:
            yield np.unique(h[cut[d] : cut[d + 1]])
        elif n:
            x = np.zeros(1, np.uint64)
            for w in words[begins[d] : begins[d + 1]]:
                x = (x + w) * np.uint64(_P)
            yield mix(x + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
