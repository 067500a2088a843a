"""N-gram Jaccard join by grouped prefix join.

Every document is the set of its distinct k-word shingles. Shingles have one global
order: rare ones by hash first, frequent ones by count last. Two sets with Jaccard
similarity t or more share a shingle among their first n - ceil(t n) + 1 ones, their prefixes.

1. Equal sets are one class, named by its smallest doc_id. Classes with identical prefix and size are one group, over
   all tasks: one row with the prefix for each group goes into the posting lists, however many documents it stands for.
2. In each posting list, pairs of groups are filtered by size and by the places of the common shingle. A list that stands for
   few classes gives all its pairs. A long one (near copies, boilerplate) gives stars: each group is paired with the lists' hubs,
   of which it keeps the first in a random order, for two such orders; so a group has two such pairs at most.
3. Surviving group pairs are expanded to members (stars: to all members of the one and the hub's first), dropped if parity signatures tell
   enough differing elements (never a link), and verified on the whole sets.
4. Long lists whose members are in one component by now are done. The others get a star around another hub. What that
   leaves is compared across components, in blocks of bounded size: all members outside the list's largest component against all others by their signatures.
   Each such member is verified with its nearest only, as long as that joins components; then all pairs still across components are verified, which
   then are few. Where no signatures leave a pair open, nothing is left to verify.

So every link between different texts that matters for the components is verified, but pairs inside a large group of
copies are never emitted. Lists of very frequent shingles are dealt in pieces, each with hubs of its own, which step 4 brings together.

Nulls and edge cases: a null or empty text, or one of white space, is the empty set and links with nothing;
a text with fewer than k words is one shingle; equal sets are one class; rows without doc_id are
ignored; repeated doc_id rows are separate members of one component id; an empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, lean, n_parts, release, store
from ._text import chunks, mix, shingle_sets
from .components import connected_components

FLUSH = 1_500_000
BITS = 1024
_SEEDS = (0, 0x5851F42D4C957F2D)
_SETS = "doc_id long, n int, s1 long, s2 long, g long, sig binary, prefix binary"
_SET_TYPES = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("g", pa.int64()), ("sig", pa.binary()), ("prefix", pa.binary())])


def _scan_frequent(k: int):
    def run(batches):
        seen, parts, size = set(), [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
            keep = counts > 1
            return pa.RecordBatch.from_pydict({"token": tokens[keep].view(np.int64), "c": counts[keep].astype(np.int64)})

        for batch in batches:
            for _, raw, offs in chunks(batch.column("text")):
                for u in shingle_sets(raw, offs, k):
                    key = hashlib.blake2b(u.tobytes(), digest_size=8).digest()
                    if len(u) and key not in seen:
                        seen.add(key)
                        parts.append(u)
                        size += len(u)
                if size > 2 * FLUSH:
                    yield flush()
                    seen, parts, size = set(), [], 0
        if parts:
            yield flush()

    return run


def frequent_shingles(docs: DataFrame, k: int, most: int):
    """The shingles put last in the order: (sorted tokens, counts), at most `most`.

    The counts take in all documents but for shingles seen once in a block. They only choose
    an order, so the result of the join does not depend on them; their number is bounded.
    """
    found = docs.select("text").mapInArrow(lean(_scan_frequent(k)), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    top = found.where("c >= 4").orderBy(F.desc("c"), "token").limit(most).toArrow()
    tokens, counts = top["token"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order].copy(), counts[order].copy()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def signature(u: np.ndarray) -> bytes:
    """Parity of the set's hashes in each of 2**i bins, BITS at least and one for each element. Two signatures differ in at most as many bits as the sets have elements apart."""
    bits = max(BITS, 1 << (len(u) - 1).bit_length()) if len(u) else BITS
    return np.packbits((np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """The same set's signature of `words` 64-bit words, from a wider one."""
    return np.bitwise_xor.reduce(sig.reshape(-1, words), axis=0)


def _scan_sets(k, num, den, frequent):
    def run(batches):
        ftok, fcnt = frequent.value
        seen: set = set()
        out: dict = {f.name: [] for f in _SET_TYPES}
        size = 0

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SET_TYPES], schema=_SET_TYPES)
            for x in out.values():
                x.clear()
            return got

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for a, raw, offs in chunks(batch.column("text")):
                for d, u in enumerate(shingle_sets(raw, offs, k), a):
                    n = len(u)
                    s1, s2 = np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    sig, g, prefix = signature(u), 0, None
                    if n:
                        if len(ftok):
                            at = np.minimum(np.searchsorted(ftok, u), len(ftok) - 1)
                            often = ftok[at] == u
                            if often.any():
                                late = u[often]
                                u = np.concatenate([u[~often], late[np.argsort(fcnt[at[often]], kind="stable")]])
                        prefix = u[: prefix_length(n, num, den)].tobytes()
                        g = int.from_bytes(hashlib.blake2b(prefix + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                        if g in seen:  # this task has given the group's prefix
                            prefix = None
                        else:
                            seen.add(g)
                            size += len(prefix)
                    for x, y in zip(out.values(), (keys[d], n, s1, s2, g, sig, prefix)):
                        x.append(y)
                    size += len(sig)
                if size > 8 * FLUSH or len(out["n"]) > 50_000:
                    yield flush()
                    size = 0
                    if len(seen) > 500_000:
                        seen.clear()
        if out["n"]:
            yield flush()

    return run


def _one_each(batches):
    """Rows of (g, n, m, prefix), sorted by g with its number of classes first -> one row for each group."""
    last, many, done = None, 1, False
    for batch in batches:
        m, at, ms = batch.column("m").to_pylist(), [], []
        bare = batch.column("prefix").is_null().to_pylist()
        for i, g in enumerate(batch.column("g").to_pylist()):
            if g != last:
                last, many, done = g, 1, False
            if bare[i]:
                many = min(m[i], 1 << 31)
            elif not done:
                done = True
                at.append(i)
                ms.append(many)
        few = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_pydict({"g": few.column("g"), "n": few.column("n"), "m": pa.array(ms, pa.int64()), "prefix": few.column("prefix")})


def _postings(parts: int, hot):
    """Groups (g, n, m, prefix) -> blocks of postings, dealt by shingle."""

    def deal(held):
        g, n, m, prefixes = zip(*held)
        lens = np.array([len(p) // 8 for p in prefixes])
        tok = np.frombuffer(b"".join(prefixes), np.uint64)
        g, group = np.array(g, np.int64), np.repeat(np.arange(len(held)), lens)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
        piece = np.zeros(len(tok), np.uint64)  # 0: the whole list; pieces of a hot shingle's count from 1
        htok, pieces = hot.value
        if len(htok):
            at = np.minimum(np.searchsorted(htok, tok), len(htok) - 1)
            is_hot = htok[at] == tok
            piece[is_hot] = mix(g[group[is_hot]].view(np.uint64)) % pieces[at[is_hot]] + np.uint64(1)
        to = (mix(tok + piece) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        n, m = np.array(n, np.uint32), np.array(m, np.uint32)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        blobs = []
        for p in full:
            o = order[cut[p] : cut[p + 1]]
            have, times = np.unique(group[o], return_counts=True)  # a group's shingles stand together
            blobs.append(_pack(g[have], tok[o], n[have], m[have], times, pos[o], piece[o]))
        return pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "block": pa.array(blobs, pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "m", "prefix"))):
                held.append(row)
                size += len(row[3])
                if size > 8 * FLUSH:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)

    return run


_FIELDS = (np.int64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)


def _pack(g, tok, n, m, times, pos, piece) -> bytes:
    """Groups' ids, shingles, groups' sizes, numbers of classes and numbers of shingles here; for each shingle its place in the prefix and its piece.
    Bytes of one rank stand together, so the high ones, which are nearly all zero, compress."""
    planes = lambda x: x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return np.array([len(g), len(tok)], np.int64).tobytes() + b"".join(planes(np.ascontiguousarray(x.astype(t))) for x, t in zip((g, tok, n, m, times, pos, piece), _FIELDS))


def _unpack(blob):
    groups, tokens = np.frombuffer(blob, np.int64, 2).tolist()
    out, at = [], 16
    for t, length in zip(_FIELDS, (groups, tokens, groups, groups, groups, tokens, tokens)):
        size = np.dtype(t).itemsize
        out.append(np.frombuffer(blob, np.uint8, length * size, at).reshape(size, length).T.copy().view(t).reshape(length))
        at += length * size
    return out


def passes(na, pa_, nb, pb, num, den):
    """Size and position filters; pa_ and pb are the places of a first common shingle."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-num * (na + nb) // (num + den))
    return (small * den >= large * num) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


_FOUND = "kind int, a long, b long, token long, n int, pos int"


def _found(kind, a, b=None, token=None, n=None, pos=None):
    size = len(a)
    column = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x.astype(t.to_pandas_dtype()), t)
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(size, kind, np.int32)), "a": column(a, pa.int64()), "b": column(b, pa.int64()), "token": column(token, pa.int64()), "n": column(n, pa.int32()), "pos": column(pos, pa.int32())})


def _match(num, den, short):
    """Blocks sorted by part -> group pairs of short lists (kind 0), the groups of long lists (1), hubs of groups (2 + order; token is the hub's place in it), groups to be paired in themselves (9)."""

    def one(blobs):
        got = [_unpack(b) for b in blobs]
        first = np.cumsum([0] + [len(x[0]) for x in got])
        g, tok, n, m, _, pos, piece = (np.concatenate([x[i] for x in got]) for i in range(7))
        who = np.concatenate([np.repeat(np.arange(len(x[0])) + b, x[4]) for x, b in zip(got, first)])
        got = None
        order = np.lexsort((piece, tok))
        tok, piece, who, pos = tok[order], piece[order], who[order], pos[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (piece[1:] != piece[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(tok)))
        classes = np.add.reduceat(m[who].astype(np.int64), begin)
        stay = (classes > 1) | (piece[begin] > 0)  # lists with something to pair
        keep = np.repeat(stay, size)
        tok, piece, who, pos = tok[keep], piece[keep], who[keep], pos[keep].astype(np.int64)
        size, classes = size[stay], classes[stay]
        begin = np.cumsum(size) - size
        if not len(tok):
            return
        hot = (classes > short) | (piece[begin] > 0)
        gs, ns = g[who], n[who].astype(np.int64)
        left, right = [], []
        for d in range(short):  # all pairs of short lists, d apart; d = 0 pairs a group's own members
            b, s = begin[~hot & (size > d)], size[~hot & (size > d)]
            if len(b):
                i = np.repeat(b, s - d) + np.arange((s - d).sum()) - np.repeat(np.cumsum(s - d) - (s - d), s - d)
                i = i[m[who[i]] > 1] if not d else i
                left.append(i)
                right.append(i + d)
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            ok = (i == j) | passes(ns[i], pos[i], ns[j], pos[j], num, den)
            pair = np.unique(np.stack([np.minimum(gs[i[ok]], gs[j[ok]]), np.maximum(gs[i[ok]], gs[j[ok]])], 1), axis=0)
            yield _found(0, pair[:, 0], pair[:, 1])
        i = np.flatnonzero(np.repeat(hot, size))
        if not len(i):
            return
        yield _found(1, gs[i], token=tok[i].view(np.int64), n=ns[i], pos=pos[i])
        yield _found(9, np.unique(gs[i[m[who[i]] > 1]]))
        lists = np.repeat(np.arange(hot.sum()), size[hot])
        for kind, seed in enumerate(_SEEDS, 2):
            place = mix(gs[i].view(np.uint64) ^ np.uint64(seed)) >> np.uint64(1)
            order = np.lexsort((place, lists))
            hub = order[np.flatnonzero(np.append(True, lists[order][1:] != lists[order][:-1]))][lists]
            ok = (gs[i[hub]] != gs[i]) & passes(ns[i], pos[i], ns[i[hub]], pos[i[hub]], num, den)
            a, b, place = gs[i[hub]][ok], gs[i][ok], place[hub][ok].view(np.int64)
            order = np.lexsort((place, b))
            order = order[np.append(True, b[order][1:] != b[order][:-1])[: len(order)]]
            yield _found(kind, a[order], b[order], token=place[order])

    def run(batches):
        part, blobs = None, []
        for batch in batches:
            for p, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if p != part and blobs:
                    yield from one(blobs)
                    blobs = []
                part = p
                blobs.append(block)
        if blobs:
            yield from one(blobs)

    return run


def _bitmap_bits(spark, ids: DataFrame, most: int = 27) -> tuple[int, np.ndarray | None]:
    """A bitmap over hashed ids with 16 bits or more for each: passes every id and few others. None if that takes over 2**most bits."""
    bits = max(16, (16 * ids.count()).bit_length())
    if bits > most:
        return bits, None
    h = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(F.shiftright(h, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << bits}) & 31 as int))").alias("x"))
    got = words.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["w"].to_numpy()] = got["x"].to_numpy().astype(np.uint32)
    return bits, out


def _emit_sets(k, bloom):
    def run(batches):
        bits = bloom.value if bloom else None
        for batch in batches:
            if bits is not None:
                h = batch.column("h").to_numpy()
                keep = np.flatnonzero((bits[h >> 5] >> (h & 31).astype(np.uint32)) & np.uint32(1))
                if not len(keep):
                    continue
                batch = batch.take(pa.array(keep))
            ids = batch.column("doc_id")
            for a, raw, offs in chunks(batch.column("text")):
                sets = [u.tobytes() for u in shingle_sets(raw, offs, k)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(a, len(sets)), "shingles": pa.array(sets, pa.binary())})

    return run


def _verify(num, den):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(both) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(sa, sb) -> np.ndarray:
    """Differing bits of signatures: at most the elements that the sets have apart."""
    return np.bitwise_count(sa ^ sb).sum(-1, dtype=np.int64)


def _apart_at(sig, i, j, some: int = 1 << 14) -> np.ndarray:
    """_apart() of the rows i and j, of which no more than `some` are copied at a time."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), some):
        out[a : a + some] = _apart(sig[i[a : a + some]], sig[j[a : a + some]])
    return out


def _near(sa, sb, total, num, den):
    """Whether two signatures leave open that the sets link: den * (S - D) >= num * (S + D) for D, the elements apart."""
    return _apart(sa, sb) * (den + num) <= total * (den - num)


def _narrow(column) -> np.ndarray:
    """Signatures of BITS bits, one row each."""
    out = np.empty((len(column), BITS // 64), np.uint64)
    for i, x in enumerate(column):
        x = np.frombuffer(x.as_buffer(), np.uint64)
        out[i] = x if len(x) == BITS // 64 else fold(x, BITS // 64)
    return out


def _narrowed(batches):
    for batch in batches:
        sigs = _narrow(batch.column("sig"))
        yield batch.set_column(batch.schema.get_field_index("sig"), "sig", pa.array([x.tobytes() for x in sigs], pa.binary()))


def _prefilter(num, den):
    def run(batches):
        for batch in batches:
            total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            sa, sb = batch.column("ga"), batch.column("gb")
            la, lb = pc.binary_length(sa).to_numpy(), pc.binary_length(sb).to_numpy()
            keep = np.zeros(len(total), bool)
            narrow = np.maximum(la, lb) == BITS // 8
            at = pa.array(np.flatnonzero(narrow))
            keep[narrow] = _near(_narrow(sa.take(at)), _narrow(sb.take(at)), total[narrow], num, den)
            for i in np.flatnonzero(~narrow):
                x, y = (fold(np.frombuffer(c[int(i)].as_buffer(), np.uint64), min(la[i], lb[i]) // 8) for c in (sa, sb))
                keep[i] = _near(x, y, total[i], num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


_CELL = ("token", "i", "j", "doc", "n", "pos", "c", "block")


def _cross(num, den, nearest: bool, most=1 << 18):
    """Pairs across components of rows sorted by their cell (token, i, j), which has a few blocks' rows: all that may link, or of each minor member the one nearest by signatures."""

    def pairs(doc, n, pos, c, block, sig):
        step = max(1, most // max(1, len(doc)))
        for s in range(0, len(doc), step):
            rows = np.arange(s, min(len(doc), s + step))
            i, j = np.nonzero((doc[rows][:, None] < doc[None]) & (c[rows][:, None] != c[None]) & ((block[rows][:, None] != block[None]) | (block.min() == block.max())))
            i = rows[i]
            ok = passes(n[i], pos[i], n[j], pos[j], num, den)
            i, j = i[ok], j[ok]
            total, apart = n[i] + n[j], _apart_at(sig, i, j)
            ok = apart * (den + num) <= total * (den - num)
            i, j, share = i[ok], j[ok], apart[ok] / total[ok]
            if nearest:
                i, j, share = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(share, 2)
                ok = block[i] >= 0
                i, j, share = i[ok], j[ok], share[ok]
            yield doc[i], doc[j], share

    def reduced(held):
        a, b, share = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, share, a) if nearest else (b, a))
        a, b, share = a[order], b[order], share[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (False if nearest else b[1:] != b[:-1])
        return a[first], b[first], share[first]

    def run(batches):
        held, size, tail = [], 0, None

        def cells(cols, last):
            """Cells but for the last one, which may go on in the next batch."""
            key = np.stack(cols[:3], 1)
            cut = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
            for a, b in zip(cut, np.append(cut[1:], len(key)) if last else cut[1:]):
                yield from pairs(*(x[a:b] for x in cols[3:]))
            cols[:] = [x[cut[-1] :] for x in cols]

        def given():
            a, b, share = held.pop()
            return pa.RecordBatch.from_pydict({"a": a, "b": b, "share": share})

        def found():
            nonlocal tail
            for batch in batches:
                if batch.num_rows:
                    cols = [batch.column(x).to_numpy().astype(np.int64) for x in _CELL] + [_narrow(batch.column("sig"))]
                    tail = cols if tail is None else [np.concatenate(x) for x in zip(tail, cols)]
                    yield from cells(tail, False)
            if tail is not None:
                yield from cells(tail, True)

        for p in found():
            if not len(p[0]):
                continue
            held.append(p)
            size += len(p[0])
            if size > most:
                held[:] = [reduced(held)]
                size = len(held[0][0])
                if size > most // 2:
                    yield given()
                    size = 0
        if held:
            held[:] = [reduced(held)]
            yield given()

    return run


def cross_pairs(members: DataFrame, num: int, den: int, block: int = 1024, nearest: bool = False) -> DataFrame:
    """All pairs (a, b) across components within the lists of members (token, doc, n, pos, c, sig) that pass the filters.

    A list's largest component is dealt in blocks of about `block` members, the others (the minor ones) in blocks of their own. Each minor block
    meets each other block in a cell of its own; blocks of the largest component don't meet, so near copies cost what lies apart from them.
    With nearest, only the pair of each minor member with the one nearest to it by signatures.
    """
    per = members.groupBy("token", "c").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
    per = per.select("token", F.col("top.c").alias("major"), F.ceil(F.col("top.n") / block).cast("int").alias("majors"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("minors")).where("minors > 0")
    given = members.join(per, "token").withColumn("is_major", F.col("c") == F.col("major"))
    given = given.withColumn("block", F.expr("cast(if(is_major, -1 - pmod(xxhash64(doc), majors), pmod(xxhash64(doc), minors)) as int)"))
    given = given.withColumn("other", F.explode(F.sequence(F.when(F.col("is_major"), 0).otherwise(-F.col("majors")), F.col("minors") - 1)))
    given = given.withColumn("i", F.expr("if(block < 0, other, if(other < 0, block, least(block, other)))")).withColumn("j", F.expr("if(block < 0, block, if(other < 0, other, greatest(block, other)))"))
    dealt = given.select(*_CELL, "sig").repartition(n_parts(members.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = dealt.mapInArrow(lean(_cross(num, den, nearest)), "a long, b long, share double")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("share", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"))
    return found.select("a", "b").distinct()


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, heavy: int = 4096) -> DataFrame:
    """Those of the (a, b) pairs that link. Sets are made again from the texts of the documents in pairs only, found by
    a bitmap where there are a few million of them at most, by a join beyond. The set of a document in more than `heavy` pairs (a hub) is
    copied once for each `heavy` of them, which are dealt over as many tasks."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("n"))
    ids = store(ids, "ids")
    bits, bitmap = _bitmap_bits(spark, ids)
    if bitmap is None:
        bloom, given = None, docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    else:
        bloom, given = spark.sparkContext.broadcast(bitmap), docs.select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id), {1 << bits})").alias("h"))
    sets = store(given.mapInArrow(lean(_emit_sets(k, bloom)), "doc_id long, shingles binary"), "sets")
    hubs = ids.where(F.col("n") > heavy).select("id", F.ceil(F.col("n") / heavy).alias("k"))
    n_hubs = hubs.count()

    def attached(rows, key, name):
        own = sets.select(F.col("doc_id").alias(key), F.col("shingles").alias(name))
        if not n_hubs:
            return rows.join(own, key)
        known = hubs.withColumnRenamed("id", key)
        known = F.broadcast(known) if n_hubs <= 100_000 else known
        rows = rows.join(known, key, "left").withColumn("deal", F.expr("coalesce(pmod(xxhash64(a, b), k), 0L)")).drop("k")
        own = own.join(known, key, "left").withColumn("deal", F.expr("explode(sequence(0L, coalesce(k, 1L) - 1))")).drop("k")
        return rows.join(own, [key, "deal"]).drop("deal")

    both = attached(attached(pairs, "a", "sa"), "b", "sb")
    out = store(both.select("a", "b", "sa", "sb").mapInArrow(lean(_verify(num, den)), "a long, b long"), "links")
    discard(sets)
    discard(ids)
    if bloom:
        bloom.destroy()
    release(spark)
    return out


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, most_frequent: int = 1 << 17, short: int = 4, star_rounds: int = 1, nearest_rounds: int = 2, list_rows: int = 4_000_000, heavy: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document; components of Jaccard similarity >= num / den.

    most_frequent bounds the shingles that the order puts last (it changes cost, not results); lists that stand for up
    to `short` classes give all pairs; star_rounds is how many stars the others get before members are compared across components, nearest_rounds how often with their nearest only. A task's
    memory holds about list_rows postings, and a hot shingle's list is dealt in pieces of a fortieth of that; heavy is how many pairs share one copy of a hub's set.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    tokens, counts = frequent_shingles(docs, k, most_frequent)
    frequent = spark.sparkContext.broadcast((tokens, counts))
    sets = store(docs.mapInArrow(lean(_scan_sets(k, num, den, frequent)), _SETS), "scan")
    frequent.destroy()
    classes = store(sets.where("n > 0").groupBy("s1", "s2", "n", "g").agg(F.min("doc_id").alias("doc")), "classes")
    groups = classes.groupBy("g").agg(F.count("*").alias("m"), F.min("doc").alias("lead")).where("m > 1")
    named = classes.join(groups, "g", "left").select("doc", "s1", "s2", F.coalesce(F.col("lead") == F.col("doc"), F.lit(True)).alias("lead"))
    # one row for each class: the document that stands for it, its group and whether it stands for that, too
    members = store(sets.where("n > 0").select(F.col("doc_id").alias("doc"), "s1", "s2", "g", "n", "sig").join(named, ["doc", "s1", "s2"]).select("doc", "g", "n", "sig", "lead"), "members")
    hot = counts > max(1000, list_rows // 40)
    hot = spark.sparkContext.broadcast((tokens[hot], -(-counts[hot] // max(1000, list_rows // 40)).astype(np.uint64)))
    total = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    parts = max(n_parts(spark), -(-total // (8 * list_rows)))
    rows = sets.where("prefix is not null").select("g", "n", F.lit(None).cast("long").alias("m"), "prefix").unionByName(groups.select("g", F.lit(None).cast("int").alias("n"), "m", F.lit(None).cast("binary").alias("prefix")))
    rows = rows.repartition(n_parts(spark), "g").sortWithinPartitions("g", F.desc_nulls_last("m"))
    single = store(rows.mapInArrow(lean(_one_each), "g long, n int, m long, prefix binary"), "groups")
    prefixes, sets = sets, store(sets.select("doc_id", "n", "s1", "s2"), "sizes")  # prefixes and signatures have done
    discard(prefixes)
    release(spark)
    lists = single.mapInArrow(lean(_postings(parts, hot)), "part int, block binary")  # they lie on disk once, as they are dealt
    found = store(lists.repartition(n_parts(spark), "part").sortWithinPartitions("part").mapInArrow(lean(_match(num, den, short)), _FOUND), "pairs")
    discard(single)
    release(spark)
    x = members.select(F.col("g").alias("gx"), F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    y = members.select(F.col("g").alias("gy"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"), "lead")

    def expanded(pairs, stars):
        """Pairs of members, which the signatures leave open: of all members of pairs (a, b), and of stars (a, b) the first of a with all of b."""
        parts = [p.select(F.col("a").alias("gy"), F.col("b").alias("gx")).join(x, "gx").join(other, "gy") for p, other in ((pairs, y), (stars, y.where("lead"))) if p is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return left_open(both.where("a <> b"))

    def left_open(pairs):
        tested = pairs.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(lean(_prefilter(num, den)), "a long, b long")
        return store(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")

    hubs = found.where("kind between 2 and 8").groupBy("kind", "b").agg(F.min(F.struct("token", "a")).alias("h")).select(F.col("h.a").alias("a"), "b")
    own = found.where("kind = 9").select("a", F.col("a").alias("b"))
    candidates = expanded(found.where("kind = 0").select("a", "b").distinct(), hubs.unionByName(own).distinct())
    release(spark)
    links = verified(docs, candidates, k, num, den, heavy)
    discard(candidates)
    made, open_ = [links], None
    rest = found.where("kind = 1").select("token", F.col("a").alias("g"), "n", "pos")
    how, turn = "star" if star_rounds else "nearest", 0
    while True:
        comp = connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("c"))
        placed = lambda rows: rows.join(comp, "doc", "left").withColumn("c", F.coalesce("c", "doc"))
        rest = rest.join(placed(members.select("doc", "g")).groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "g")
        per = rest.groupBy("token").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
        was, open_ = open_, store(rest.join(per.where("first < last").select("token"), "token"), "open")
        discard(was if turn else found)
        if not open_.take(1):
            break
        if how == "star":  # each group with one hub: the first in this turn's random order of those its lists begin with
            key = F.struct(F.xxhash64("g", F.lit(turn)).alias("at"), "g", "n", "pos", "lo", "hi")
            hub = open_.groupBy("token").agg(F.min(key).alias("h"))
            pair = open_.join(hub, "token").where("lo <> h.lo or hi <> h.hi or lo <> hi")
            need = f"ceil({num} * (n + h.n) / {num + den}D)"
            pair = pair.where(f"g = h.g or least(n, h.n) * {den} >= greatest(n, h.n) * {num} and 1 + least(n - pos - 1, h.n - h.pos - 1) >= {need}")
            pair = pair.groupBy(F.col("g").alias("b")).agg(F.min(F.struct("h.at", "h.g")).alias("h")).select(F.col("h.g").alias("a"), "b")
            candidates = expanded(None, pair)
        else:
            narrow = members.select("doc", "g", "sig").mapInArrow(lean(_narrowed), "doc long, g long, sig binary")  # sent once for each list and cell
            pair = cross_pairs(open_.select("token", "g", "n", "pos").join(placed(narrow), "g"), num, den, nearest=how == "nearest")
            signs = members.select("doc", "n", "sig")
            pair = store(pair, "nearest")
            if not pair.take(1):
                discard(pair)
                break
            candidates = left_open(pair.join(signs.toDF("a", "na", "ga"), "a").join(signs.toDF("b", "nb", "gb"), "b"))
            discard(pair)
        more = verified(docs, candidates, k, num, den, heavy)
        discard(candidates)
        made.append(more)
        links = links.unionByName(more)
        rest = open_.select("token", "g", "n", "pos")
        if how == "all":
            break
        turn += 1
        if how == "nearest":
            how = "nearest" if turn < star_rounds + nearest_rounds and more.take(1) else "all"
        elif turn >= star_rounds:
            how = "nearest"
    comp = connected_components(links)
    for t in (*made, open_, members):
        discard(t)
    release(spark)
    named = classes.join(comp, classes.doc == comp.node, "left").select("s1", "s2", "n", F.coalesce("component", "doc").alias("component_id"))
    full = sets.where("n > 0").select("doc_id", "s1", "s2", "n").join(named, ["s1", "s2", "n"]).select("doc_id", "n", "component_id")
    empty = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
