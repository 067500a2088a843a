"""Resharding by minimum-cost flow.

Rows lie in old shards; new shards have capacities in bytes. Rows are gathered into blocks
(equal texts share a block); only the blocks' sizes, a number of rows bounded by
parameters, reach the driver. There a minimum-cost flow from old shards to new ones
finds how many bytes move between each two, at cost 0 for staying and 1 a byte for moving. Blocks
are then cut along that flow, and a row's new shard and place follow from its block.
Only files of shards that gain or lose rows are written again (rewrite_affected), in the order of their slots;
read_shards reads them back, with shard and slot as they lie in the files.

The law is `bytes`: shards' sizes are near equal. A block larger than 1 / grain of a
capacity is split by text; only the rows of one text that alone takes over 1 / hot of a capacity are split by document,
so a group of equal texts that holds a third of all rows is spread, and all others stay together.
Edge cases: rows whose old shard is null or no number of an old shard lie in none and are all moved; null or empty text counts its overhead only, its checksum is 0; null
doc_id rows are placed like others; repeated rows are all placed; an empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import n_parts, store


def min_cost_flow(supply: list[int], demand: list[int], cost) -> np.ndarray:
    """Flow matrix of least total cost from supplies to demands (equal sums), by successive shortest paths."""
    n, m = len(supply), len(demand)
    flow = np.zeros((n, m), np.int64)
    left, need = list(supply), list(demand)
    potential = [0.0] * (n + m)
    while any(left):
        best, source, heap = {}, {}, []
        for i in range(n):
            if left[i]:
                best[i] = 0.0
                heapq.heappush(heap, (0.0, i))
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            near = ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in range(n) if flow[i, u - n])
            for v, c in near:
                step = d + max(0.0, c + potential[u] - potential[v])
                if v not in done and step < best.get(v, float("inf")):
                    best[v], source[v] = step, u
                    heapq.heappush(heap, (step, v))
        end = min((n + j for j in range(m) if need[j]), key=lambda v: (best[v], v))
        far = best[end]
        for v in range(n + m):
            potential[v] += min(best.get(v, far), far)
        path = [end]
        while path[-1] in source:
            path.append(source[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[end - n], *(int(flow[v, u - n]) for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[path[0]] -= amount
        need[end - n] -= amount
    return flow


class BlockPlan:
    """Where rows go: place() adds shard and first_slot to rows; affected are the shards that gain or lose rows."""

    def __init__(self, docs: DataFrame, old_shard, new_shards: int = 24, old_shards: int = 16, overhead: int = 8, blocks: int = 256, grain: int = 64, hot: int = 4) -> None:
        self.old_shard, self.overhead, self.blocks = F.when(old_shard.between(0, old_shards - 1), old_shard).otherwise(old_shards), overhead, blocks  # old_shards: in none
        self.spark, self.old_shards = docs.sparkSession, old_shards
        spark = self.spark
        self.rows = store(self._keyed(docs, "doc_id"), "sizes")
        whole = self.rows.groupBy("__old", "__block").agg(F.sum("__size").alias("bytes"))
        total = whole.agg(F.sum("bytes")).first()[0] or 0
        capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
        most = max(1, total // new_shards // grain)
        big = whole.where(F.col("bytes") > most)
        large = self.rows.join(F.broadcast(big.select("__old", "__block")), ["__old", "__block"]).groupBy("__old", "__block", "__t").agg(F.sum("__size").alias("bytes"))
        large = sorted((r["__old"], r["__block"], r["__t"], r.bytes) for r in large.where(F.col("bytes") > max(most, total // new_shards // hot)).collect())  # at most new_shards * hot
        left = {(r["__old"], r["__block"]): r.bytes for r in big.collect()}  # at most old_shards * blocks
        self.hot, base = [], 1
        for o, block, t, size in large:
            left[o, block] -= size
            self.hot.append((o, block, t, base, -(-size // most)))
            base += self.hot[-1][-1]
        self.big = spark.createDataFrame([(o, block, max(1, -(-size // most))) for (o, block), size in left.items()], "__old int, __block int, __splits int")
        self.hot = spark.createDataFrame(self.hot, "__old int, __block int, __t long, __base int, __parts int")
        found = sorted((r["__old"], r["__block"], r["__sub"], r.bytes, r.n) for r in self._split(self.rows).groupBy("__old", "__block", "__sub").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n")).collect())
        supply = [0] * (old_shards + 1)
        for o, _, _, size, _ in found:
            supply[o] += size
        flow = min_cost_flow(supply, capacity, lambda i, j: 0.0 if i == j < old_shards else 1.0)
        plan, need, next_slot = [], np.zeros(new_shards, np.int64), [0] * new_shards
        for o in range(old_shards + 1):
            need += flow[o]
            wanted = np.flatnonzero(flow[o])
            for _, block, sub, size, n in sorted((x for x in found if x[0] == o), key=lambda x: (-x[3], x[1:3])):
                j = int(wanted[np.argmax(need[wanted])])  # largest block first, to where most is still to come
                need[j] -= size
                plan.append((o, block, sub, j, next_slot[j]))
                next_slot[j] += n
        self.affected = sorted({s for o, _, _, j, _ in plan if not o == j < old_shards for s in (o, j) if s < old_shards or s == j})
        self.to = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "__old int, __block int, __sub int, shard int, first_slot long")

    def _keyed(self, docs: DataFrame, *keep) -> DataFrame:
        text = F.xxhash64("text")
        return docs.select(
            *keep, (F.coalesce(F.octet_length("text"), F.lit(0)) + self.overhead).cast("long").alias("__size"), F.crc32(F.coalesce("text", F.lit(""))).alias("__crc"),
            self.old_shard.cast("int").alias("__old"), text.alias("__t"), F.pmod(text, F.lit(self.blocks)).cast("int").alias("__block"),
        )

    def _split(self, rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(self.big), ["__old", "__block"], "left").join(F.broadcast(self.hot), ["__old", "__block", "__t"], "left")
        sub = "case when __parts is not null then -(__base + pmod(xxhash64(doc_id), __parts)) else coalesce(pmod(xxhash64(__t), __splits), 0) end"
        return rows.withColumn("__sub", F.expr(sub).cast("int")).drop("__splits", "__base", "__parts")

    def place(self, rows: DataFrame) -> DataFrame:
        return self._split(rows).join(F.broadcast(self.to), ["__old", "__block", "__sub"])

    def slots(self) -> DataFrame:
        """(doc_id, size, text_crc32, old_shard, shard, slot) of all rows, as planned."""
        within = Window.partitionBy("__old", "__block", "__sub").orderBy("doc_id", "__crc")
        placed = self.place(self.rows).withColumn("at", F.row_number().over(within) - 1)
        return placed.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.nullif(F.col("__old"), F.lit(self.old_shards)).alias("old_shard"), "shard", (F.col("first_slot") + F.col("at")).alias("slot"))


def reshard(docs: DataFrame, old_shard, new_shards: int = 24, old_shards: int = 16, overhead: int = 8, blocks: int = 256, grain: int = 64, hot: int = 4) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for each row; slot counts from 0 in each shard, without gaps.

    old_shard is a column expression giving 0 .. old_shards - 1. Each old shard has `blocks` blocks, and a block over
    capacity / grain bytes is split into as many as needed, by text; texts over capacity / hot by document: at most
    old_shards * blocks + 2 * new_shards * grain rows, and new_shards * hot texts, reach the driver.
    """
    return BlockPlan(docs, old_shard, new_shards, old_shards, overhead, blocks, grain, hot).slots()


def rewrite_affected(docs: DataFrame, plan: BlockPlan, path: str) -> list[int]:
    """Writes the rows of all shards that gain or lose some, in the order of their slots, one folder a shard; returns these shards.

    Every row is written, repeated ones too, with its own columns; one named shard gives way to the new shard.
    """
    own = [c for c in docs.columns if c.lower() != "shard"]
    placed = plan.place(plan._keyed(docs, *own)).where(F.col("shard").isin(plan.affected))
    order = ["shard", "first_slot", "doc_id", "__crc"]
    dealt = placed.repartitionByRange(n_parts(plan.spark), *order).sortWithinPartitions(*order)
    dealt.select(*own, "shard").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return plan.affected


def read_shards(spark, path: str, columns) -> DataFrame:
    """The columns of the rows in the shards' files, with shard and slot: the row's place in its file after the files before."""
    read = spark.read.parquet(path)
    rows = read.select(*columns, F.col("shard").cast("int").alias("shard"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    ends = rows.groupBy("shard", "__file").agg(F.count("*").alias("n")).collect()  # at most a file for each partition and shard
    before: dict = {}
    starts = []
    for r in sorted(ends, key=lambda r: (r.shard, int(r["__file"].split("-")[1]))):  # part numbers are in the order of the ranges
        starts.append((r.shard, r["__file"], before.get(r.shard, 0)))
        before[r.shard] = starts[-1][2] + r.n
    starts = spark.createDataFrame(starts, "shard int, __file string, __first long")
    return rows.join(F.broadcast(starts), ["shard", "__file"]).select(*columns, "shard", (F.col("__first") + F.col("__at")).alias("slot"))
