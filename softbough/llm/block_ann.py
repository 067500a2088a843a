"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are packed into blocks: float rows, their int8 quantisation, a scale, norms and quantisation errors. Each
query block meets each candidate block once: an equi-join on a grid of query and candidate groups, of about `cell` blocks each, so the
grid grows with the tables and a cell doesn't. A tile is one integer matrix product; with
|q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'| it gives every pair a certain interval. Pairs whose upper end lies below the k-th best lower
end of their query are dropped; the others are computed again in double precision, and heaps of k merge the tiles. So the
result is exact, ties to the smaller vec_id.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
queries nor as candidates; so do rows without vec_id, and vectors of another length meet only their like; a query is
never its own candidate; repeated vec_id rows are all candidates, and a repeated query counts once; fewer than k candidates: all are returned; an empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, n_parts, store

_BLOCK = "dim int, ids binary, codes binary, stats binary, vectors binary"


def _blocks(rows: int):
    def pack(batches):
        held: dict = {}

        def one(dim):
            ids, x = zip(*held.pop(dim))
            x = np.stack(x)
            scale = np.maximum(np.abs(x).max(1) / 127, 1e-300)
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            near = codes * scale[:, None]
            norm, error, size = np.linalg.norm(x, axis=1), np.linalg.norm(x - near, axis=1), np.linalg.norm(near, axis=1)
            stats = np.stack([scale, norm, error, size], 1)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary()), "stats": pa.array([stats.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())})

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy().astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    held.setdefault(len(x), []).append((i, x))
                    if len(held[len(x)]) >= rows:
                        yield one(len(x))
        for dim in list(held):
            yield one(dim)

    return pack


def _open(r, side):
    dim = r["dim"]
    get = lambda c, t: np.frombuffer(r[f"{side}_{c}"], t)
    return get("ids", np.int64), get("codes", np.int8).reshape(-1, dim), get("stats", np.float64).reshape(-1, 4), get("vectors", np.float64).reshape(-1, dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up in order of components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _tiles(k: int):
    def rows_of(best):
        rows = [(q, -y, z) for q, heap in best.items() for z, y in heap]
        ids, vecs, scores = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_pydict({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(vecs, pa.int64()), "score": pa.array(scores, pa.float64())})

    def run(batches):
        best: dict = {}  # merged over the task's tiles; given out when it holds many queries
        for batch in batches:
            for r in batch.to_pylist():
                if len(best) > 50_000:
                    yield rows_of(best)
                    best = {}
                (qi, qc, qs, q), (ci, cc, cs, c) = _open(r, "q"), _open(r, "c")
                # products of int8 codes add up to less than 2**24 below 1040 components: exact in float32
                kind = np.float32 if qc.shape[1] <= 1040 else np.float64
                dots = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, :1] * cs[:, 0]
                slack = qs[:, 2:3] * cs[:, 1] + qs[:, 3:4] * cs[:, 2]
                slack += 1e-12 * (qs[:, 1:2] * cs[:, 1]) + 1e-300
                other = qi[:, None] != ci[None]
                lower = np.where(other, dots - slack, -np.inf)
                m = min(k, len(ci))
                floor = np.partition(lower, len(ci) - m, axis=1)[:, len(ci) - m]
                a, b = np.nonzero(other & (dots + slack >= floor[:, None]))
                for s in range(0, len(a), 1 << 18):
                    i, j = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
                    exact = inner(q[i], c[j])
                    order = np.lexsort((ci[j], -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                    place = np.arange(len(i)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(i)]])))
                    for x, y, z in zip(qi[i[place < k]].tolist(), ci[j[place < k]].tolist(), exact[place < k].tolist()):
                        heap = best.setdefault(x, [])
                        (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (z, -y))
        yield rows_of(best)

    return run


def _top(k: int):
    """Merges the tiles' lists of each query, which come together in one partition and in any order."""

    def run(batches):
        heaps: dict = {}
        for batch in batches:
            for q, v, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                heap = heaps.setdefault(q, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
        rows = [(q, n, -v, s) for q, heap in heaps.items() for n, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        for a in range(0, len(rows), 50_000):
            q, n, v, s = zip(*rows[a : a + 50_000])
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "rank": pa.array(n, pa.int32()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, query_rows: int = 512, candidate_rows: int = 2048, cell: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row against all other rows.

    is_query is a boolean column of vectors. A query block is copied to each group of `cell` (or fewer, if there are more tasks than cells)
    candidate blocks, a candidate block to each group of `cell` query blocks.
    """
    spark = vectors.sparkSession
    given = vectors.where("vec_id is not null").select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    cols = ["dim", "ids", "codes", "stats", "vectors"]
    one = lambda df, rows, what: store(df.select("vec_id", "embedding").mapInArrow(_blocks(rows), _BLOCK), what)
    cand = one(given, candidate_rows, "candidates")
    query = one(given.where("is_query").dropDuplicates(["vec_id", "embedding"]), query_rows, "queries")
    n_query, n_cand = query.count(), cand.count()
    across = max(1, -(-n_query // cell))
    down = max(1, -(-n_cand // cell), min(n_cand, -(-2 * n_parts(spark) // across)))
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    named = lambda df, s: df.select("dim", "qg", "cg", *(F.col(c).alias(f"{s}_{c}") for c in cols[1:]))
    queries = named(query.withColumn("qg", group(across)).withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))), "q")
    candidates = named(cand.withColumn("cg", group(down)).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))), "c")
    tiles = queries.join(candidates, ["dim", "qg", "cg"])
    found = store(tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double"), "heaps")
    discard(query)
    discard(cand)
    return found.repartition("query_id").mapInArrow(_top(k), "query_id long, rank int, vec_id long, score double")
