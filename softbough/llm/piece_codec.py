"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

A text's units are runs of word marks with what follows, cut where no piece holds the two characters at the cut side by side, as no merge
can cross there. A batch's distinct units are concatenated; a suffix array of that text, sorted
as deep as the longest piece, is searched by bisection for every piece of the vocabulary at once. The occurrence ranges are the edges of
a lattice, sorted by end position. Relaxation goes over the end positions of all units together: an edge is on
the encoding of its prefix if its left neighbour there and it are a pair that the model's merges leave apart, which
holds for exactly one edge of each end. So ids equal those of the sentencepiece library.

Pieces hold a word mark only at their beginning, so units are independent (checked when the model is loaded). Characters without
a piece are their UTF-8 bytes. Edge cases: null and empty texts have no ids; a text that holds the word mark U+2581 itself decodes to a space there; other
texts decode to themselves; an empty table gives no rows; repeated rows are all encoded. Other columns are kept; one named ids is replaced.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import lean, process_cache
from .token_store import _gather, _pieces, _take, remembered

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.text) if not special[i] and not sp.is_byte(i)}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark behind other characters")
        self.raw = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(self.text, special)]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.depth = max(map(len, self.ids))
        names = sorted(self.ids)
        self.piece_id = np.array([self.ids[p] for p in names])
        self.piece_len = np.array([len(p) for p in names])
        self.piece_chars = np.zeros((len(names), self.depth), np.uint32)
        for row, p in zip(self.piece_chars, names):
            row[: len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        codes = self.piece_chars.astype(np.int64)
        beside = (codes[:, :-1] << 32 | codes[:, 1:])[codes[:, 1:] > 0]
        self.beside = np.unique(beside)  # characters that stand side by side in a piece
        self.known, self.flags = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs of pieces by code, sorted
        self.recent: dict[int, bool] = {}  # and those not sorted in yet

    def merge(self, text: str) -> list[str]:
        """The model's merges applied to a short text: the best rank first, the leftmost of equal ones."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_apart(self, code: int) -> bool:
        a, b = (code >> 32) - 1, code & 0xFFFFFFFF
        if b >= self.size:
            return True
        if a < 0 or a >= self.size:
            return self.merge(self.text[b]) == [self.text[b]]
        return self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def apart(self, codes: np.ndarray, most: int = 1_000_000) -> np.ndarray:
        """Whether the merges of left + right end in these two, for codes of pairs (see pair_code)."""
        some, back = np.unique(codes, return_inverse=True)
        out = np.zeros(len(some), bool)
        new = np.ones(len(some), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
            new = self.known[at] != some
            out[~new] = self.flags[at[~new]]
        recent = self.recent
        for i in np.flatnonzero(new).tolist():
            code = int(some[i])
            ok = recent.get(code)
            if ok is None:
                ok = recent[code] = self._is_apart(code)
            out[i] = ok
        if len(recent) > max(10_000, len(self.known) // 8):
            if len(self.known) > most:
                self.known, self.flags = self.known[:0], self.flags[:0]
            codes = np.concatenate([self.known, np.fromiter(recent, np.int64, len(recent))])
            flags = np.concatenate([self.flags, np.fromiter(recent.values(), bool, len(recent))])
            order = np.argsort(codes, kind="stable")
            self.known, self.flags = codes[order], flags[order]
            recent.clear()
        return out[back]


def pair_code(left, right):
    """left -1 is a unit's beginning. Ids from the model's size on are characters without a piece."""
    return (left + 1) * (1 << 32) + right


def load(path: str) -> PieceModel:
    kept, key = process_cache(), ("piece model", path)
    if key not in kept:
        kept[key] = PieceModel(path)
    return kept[key]


def suffix_array(chars: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the text from there on, compared over at least depth characters; by prefix doubling."""
    _, rank = np.unique(chars, return_inverse=True)
    rank, done = rank.astype(np.int64) + 1, 1
    while done < depth:
        code = rank * (len(chars) + 2)
        code[:-done] += rank[done:]
        done *= 2
        order = np.argsort(code, kind="stable")
        sorted_ = code[order]
        if done < depth:
            step = np.ones(len(chars), np.int64)
            step[1:] = sorted_[1:] != sorted_[:-1]
            rank = np.empty(len(chars), np.int64)
            rank[order] = np.cumsum(step)
    return order if done > 1 else np.argsort(rank, kind="stable")


def _ranges(chars, order, model):
    """Bisection for all pieces together: the range of suffixes that begin with each."""
    padded = np.concatenate([chars, np.zeros(model.depth, np.uint32)])
    reach = np.arange(model.depth)
    inside = reach < model.piece_len[:, None]

    def bound(upper):
        lo, hi = np.zeros(len(model.piece_id), np.int64), np.full(len(model.piece_id), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            got = padded[order[mid][:, None] + reach]
            want = model.piece_chars[open_]
            differ = (got != want) & inside[open_]
            some = differ.any(1)
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            less = np.where(some, got[rows, first] < want[rows, first], upper)
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    return bound(False), bound(True)


def encode_units(units: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the units."""
    if not units:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    lens = np.array([len(u) for u in units], np.int64)
    begin = np.cumsum(lens + 1) - lens - 1
    chars = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    order = suffix_array(chars, model.depth)
    lo, hi = _ranges(chars, order, model)
    n = hi - lo
    kind = np.int32 if len(chars) * (model.depth + 1) < 1 << 31 else np.int64  # edges are many: narrow numbers halve them
    at = np.repeat((lo - (np.cumsum(n) - n)).astype(kind), n) + np.arange(n.sum(), dtype=kind)
    start, piece, size = order.astype(kind)[at], np.repeat(model.piece_id.astype(kind), n), np.repeat(model.piece_len.astype(kind), n)
    del order, at
    covered = np.zeros(len(chars), bool)
    covered[start[size == 1]] = True
    owner = np.repeat(np.arange(len(units), dtype=kind), lens + 1)
    covered[begin + lens] = True  # the separators
    alone = np.flatnonzero(~covered).astype(kind)
    start = np.concatenate([start, alone])
    piece = np.concatenate([piece, model.size + chars[alone].astype(kind)])
    size = np.concatenate([size, np.ones(len(alone), kind)])
    end = start + size - begin.astype(kind)[owner[start]]  # relative: 1 .. length of the unit
    by = np.argsort(end, kind="stable")
    start, piece, size, end = start[by], piece[by], size[by], end[by]
    cut = np.searchsorted(end, np.arange(1, lens.max() + 2))
    last = np.full(len(chars) + 1, -1, np.int64)  # by position behind the prefix
    width = np.zeros(len(chars) + 1, np.int64)
    starts = np.zeros(len(chars) + 1, bool)
    starts[begin] = True
    edges = np.diff(cut)
    few = len(edges) - int(np.argmax(edges[::-1] > 64)) if (edges > 64).any() else 0  # from this end on, few units are that long
    few = len(edges) if len(edges) - few < 500 else few
    for a, b in zip(cut[:few], cut[1 : few + 1]):
        s, t = start[a:b], piece[a:b].astype(np.int64)
        ok = model.apart(pair_code(np.where(starts[s], -1, last[s]), t))
        to = s[ok] + size[a:b][ok]
        last[to], width[to] = t[ok], size[a:b][ok]
    memo: dict[int, bool] = {}
    for s, t, n in zip(*(x[cut[few] : cut[-1]].tolist() for x in (start, piece, size))):  # the ends of very long units, one by one
        code = pair_code(-1 if starts[s] else int(last[s]), t)
        ok = memo.get(code)
        if ok is None:
            ok = memo[code] = bool(model.apart(np.array([code]))[0])
        if ok:
            last[s + n], width[s + n] = t, n
    # a unit's end is the separator's place, where no other unit begins
    at, who, steps, rows = begin + lens, np.flatnonzero(lens > 0), [], []
    at = at[who]
    while len(who):
        steps.append(last[at])
        rows.append(who)
        at = at - width[at]
        more = ~starts[at]
        at, who = at[more], who[more]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(len(units) + 1, np.int64)
    row, tok, back = np.concatenate(rows), np.concatenate(steps), np.repeat(np.arange(len(steps)), [len(r) for r in rows])
    by = np.lexsort((-back, row))
    row, tok = row[by], tok[by]
    if (tok >= model.size).any():
        some, code = np.unique(tok, return_inverse=True)
        spelled = [np.array([c] if c < model.size else [model.byte_ids[b] for b in chr(c - model.size).encode("utf-8", "surrogatepass")], np.int64) for c in some.tolist()]
        tok, offs = _gather(spelled, code)
        row = np.repeat(row, np.diff(offs))
    return tok, np.searchsorted(row, np.arange(len(units) + 1))


def _in_blocks(units: list[str], model, chars: int = 600_000) -> tuple[np.ndarray, np.ndarray]:
    """encode_units() over blocks of about so many characters."""
    total = np.cumsum([len(u) + 1 for u in units])
    toks, offs, a = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    while a < len(units):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + chars, "right")))
        tok, ends = encode_units(units[a:b], model)
        toks.append(tok.astype(np.uint32))
        offs.append(offs[-1][-1] + ends[1:])
        a = b
    return np.concatenate(toks), np.concatenate(offs)


def _fresh(units: pa.Array, model):
    """(pool, offsets) of units; those that hold the separator itself are encoded around it. Units go in blocks, so memory doesn't grow with a text."""
    names = units.to_pylist()
    tok, offs = _in_blocks(["" if "\0" in u else u for u in names], model)
    odd = [i for i, u in enumerate(names) if "\0" in u]
    if odd:
        lists = np.split(tok, offs[1:-1])
        for i in odd:
            ids = []
            for j, part in enumerate(names[i].split("\0")):
                ids += [model.byte_ids[0]] * (j > 0) + (encode_units([part], model)[0].tolist() if part else [])
            lists[i] = np.array(ids, np.int64)
        tok, offs = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return tok.astype(np.uint32), offs


def cut_units(units: list[str], model) -> tuple[list[str], np.ndarray]:
    """The units cut where no piece holds the two characters at the cut, and each one's number of parts."""
    text = "".join(units)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum([0, *map(len, units)])[:-1]
    first = np.ones(len(chars), bool)
    code = chars[:-1] << 32 | chars[1:]
    first[1:] = model.beside[np.minimum(np.searchsorted(model.beside, code), len(model.beside) - 1)] != code
    first[begin] = True
    at = np.flatnonzero(first)
    return [text[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(text)])], np.diff(np.append(np.searchsorted(at, begin), len(at)))


def encode_column(texts: pa.Array, path: str, cache_units: int = 1_000_000):
    """(ids, offsets) of a string column."""
    model = load(path)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    plain = pc.invert(pc.match_substring_regex(texts, f"  |^ | $|{MARK}|\\x00|^$"))
    words = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
    starts = words.offsets.to_numpy()
    flat = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words.flatten(), pa.scalar("", pa.large_string()))
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    counts = np.diff(starts)
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    if len(odd):
        index = {u: i for i, u in enumerate(names)}
        parts = np.split(codes, starts[1:-1] - starts[0])
        for i in odd:
            text = texts[int(i)].as_py()
            own = _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []
            parts[i] = np.array([index.setdefault(u, len(index)) for u in own], np.int64)
        names, codes, counts = list(index), np.concatenate(parts), np.array([len(p) for p in parts])
    parts, times = cut_units(names, model)
    parts = pa.array(parts, pa.large_string()).dictionary_encode()
    pool, begins, lens = remembered(parts.dictionary, ("pieces", path), lambda more: _fresh(more, model), cache_units)
    pool, offs = _take(pool, begins, lens, parts.indices.to_numpy().astype(np.int64))
    marks = offs[np.concatenate([[0], np.cumsum(times)])]
    ids, offs = _take(pool, marks[:-1], np.diff(marks), codes)
    at = np.concatenate([[0], np.cumsum(counts)])
    return ids.astype(np.uint32), offs[at]


def decode_ids(ids, path: str) -> str:
    model = load(path)
    text = b"".join([model.raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encode(path, names):
    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, 4 << 20):
                ids, offs = encode_column(piece.column("text"), path)
                cols = {c: piece.column(c) for c in names}
                yield pa.RecordBatch.from_pydict(cols | {"ids": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.view(np.int32)))})

    return run


def encode_pieces(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with ids array<int>."""
    names = [c for c in (keep or docs.columns) if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", ids array<int>"
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(lean(_encode(path, names)), schema)


def decode_pieces(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns `keep` with decoded string; null ids give null."""

    def run(batches):
        for batch in batches:
            out = [None if not x.is_valid else decode_ids(x.values.to_pylist(), path) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"decoded": pa.array(out, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema) + ", decoded string"
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(lean(run), schema)


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) in one pass: ids as little-endian unsigned 32-bit integers, and whether they decode to the text."""

    def run(batches):
        model = load(path)
        raw = model.raw
        for batch in batches:
            for piece in _pieces(batch, 4 << 20):
                ids, offs = encode_column(piece.column("text"), path)
                sums, same = [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    own = ids[offs[i] : offs[i + 1]]
                    sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                    same.append(b"".join([raw[x] for x in own.tolist()]) == (b" " + text.encode() if text else b""))
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_pieces": np.diff(offs), "ids_crc32": pa.array(sums, pa.int64()), "round_trip": pa.array(same, pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
