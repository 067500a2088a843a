"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask selects some positions of a short window of words and ignores the others, so a hash over the selected words
still hits when an ignored word was substituted. The hashes of every window of every document are joined with those of the benchmark
items; each hit gives a diagonal (document position minus item position), and along it the words are compared over the whole
item: matches count 1, mismatches cost `penalty`, and the best segment's score decides. It must reach `min_score`, or `share` percent of
the item's words if these are fewer; an item of under `exact` words must be there whole. The mask hits every overlap that reaches its score;
how often at least (least_hits) tells which diagonals need no comparison.

Words are maximal runs outside [\\x20\\x09-\\x0D], in lower case. The benchmark's seeds are broadcast if they are at most
`broadcast_rows`, else the join shuffles. Edge cases: null and empty texts match nothing; items of fewer
words than a mask spans have one key for all their words, so even an item of one word is found in each document that holds it; null ids are ignored; repeated rows count once; empty tables give no
rows. Further columns are not read.
"""
from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, store

#: Selected positions; this mask spans five words, selects four, and hits whatever scores 6 or more at a penalty of 2.
MASKS = ((0, 1, 2, 4),)
_WHITE = " \t\n\x0b\f\r"


def _words(text: str = "text"):
    return F.split(F.lower(F.trim(F.col(text), F.lit(_WHITE))), r"[\x20\x09-\x0D]+")


def _span(masks) -> int:
    return max(m[-1] for m in masks) + 1


def least_hits(masks, score: int, penalty: int) -> int:
    """The fewest hits of the masks along any overlap that reaches the score, however its substitutions lie (shortest path over the last words)."""
    full = (1 << _span(masks)) - 1
    wanted = [sum(1 << m[-1] - o for o in m) for m in masks]  # the newest word is bit 0
    heap, done = [(0, 0, 0)], set()
    while heap:
        hits, run, last = heapq.heappop(heap)
        if run >= score:
            return hits
        if (run, last) in done:
            continue
        done.add((run, last))
        for same in (1, 0):
            to, seen = run + (1 if same else -penalty), (last << 1 | same) & full
            if to > 0:
                heapq.heappush(heap, (hits + sum(seen & m == m for m in wanted), to, seen))
    return 0


def _seeds(df: DataFrame, masks, number: int, *keep) -> DataFrame:
    """One row for each mask and window: keep, pos and hash; the first mask has this number."""
    span = _span(masks)
    hashed = df.select(*keep, F.transform(_words(), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= span)
    last = F.size("h") - span

    def hashes(n, mask):
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(n), *(F.get("h", i + o) for o in mask)))

    per_mask = [hashes(n, m) for n, m in enumerate(masks, number)]
    windows = last + 1
    found = hashed.select(*keep, windows.alias("w"), F.posexplode(F.concat(*per_mask)).alias("at", "seed"))
    return found.select(*keep, F.expr("at % w").cast("int").alias("pos"), "seed")


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, penalty: int = 2, min_score: int = 10, broadcast_rows: int = 500_000, share: int = 60, exact: int = 10) -> DataFrame:
    """(doc_id, item_id, begin, matched, length, score): the best overlap of each document with each benchmark item it holds.

    begin is the overlap's first word in the document, matched of its length words agree; score is matched - penalty * others, at least min_score or
    share percent of the item's words, whichever is less; for items of under `exact` words it is their number of words.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text"), F.xxhash64("text").alias("x"))
    items = benchmark.where("item_id is not null").select("item_id", "text", F.xxhash64("text").alias("y"), F.size(_words()).alias("n")).where(F.get(_words(), 0) != "").distinct()
    span = _span(masks)
    enough = F.when(F.col("n") < exact, F.col("n")).otherwise(F.least(F.lit(min_score), F.expr(f"cast((n * {share} + 99) div 100 as int)")))
    items = items.withColumn("enough", enough)
    short = sorted(r.n for r in items.where(F.col("n") < span).select("n").distinct().collect())  # fewer than span
    kinds = [(masks, 0), *(((tuple(range(n)),), -n) for n in short)]

    def all_seeds(df, *keep, of_items=False):
        parts = [_seeds(df.where(F.col("n") == -number) if of_items and number else df.where(F.col("n") >= span) if of_items else df, m, number, *keep) for m, number in kinds]
        return reduce(DataFrame.unionByName, parts)

    seeds = store(all_seeds(items, "item_id", "y", of_items=True).withColumnRenamed("pos", "item_pos").distinct(), "seeds")
    hits = all_seeds(docs, "doc_id", "x").join(F.broadcast(seeds) if seeds.count() <= broadcast_rows else seeds, "seed")
    diagonals = hits.groupBy("doc_id", "x", "item_id", "y", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count("*").alias("hits"))
    lowest = min(min_score, -(-exact * share // 100))
    needed = F.lit(1)
    for score in range(lowest, min_score + 1):
        needed = F.when((F.col("n") >= exact) & (F.col("enough") == score), least_hits(masks, score, penalty)).otherwise(needed)
    few = items.select("item_id", "y", needed.alias("needed"))
    diagonals = store(diagonals.join(few, ["item_id", "y"]).where("hits >= needed").drop("hits", "needed"), "hits")
    discard(seeds)
    # one row for each document and item with hits, however many diagonals it has; the text comes by an equi-join on the document
    lines = diagonals.groupBy("doc_id", "x", "item_id", "y").agg(F.collect_set("shift").alias("shifts")).join(items.select("item_id", "y", "enough", _words().alias("b")), ["item_id", "y"])
    whole = docs.join(lines.hint("shuffle_hash"), ["doc_id", "x"]).select("doc_id", "item_id", "shifts", "enough", _words().alias("a"), "b")
    empty = F.expr("named_struct('at', 0, 'run', 0, 'begin', 0, 'hit', 0, 'score', 0, 'from', 0, 'upto', 0, 'matched', 0)")

    def step(s, same):
        gain = F.when(same, 1).otherwise(-penalty)
        fresh = s["run"] <= 0
        run, begin = F.when(fresh, gain).otherwise(s["run"] + gain), F.when(fresh, s["at"]).otherwise(s["begin"])
        hit = F.when(fresh, same.cast("int")).otherwise(s["hit"] + same.cast("int"))
        better = run > s["score"]
        pick = lambda new, old: F.when(better, new).otherwise(s[old])
        return F.struct((s["at"] + 1).alias("at"), run.alias("run"), begin.alias("begin"), hit.alias("hit"), pick(run, "score").alias("score"), pick(begin, "from").alias("from"), pick(s["at"] + 1, "upto").alias("upto"), pick(hit, "matched").alias("matched"))

    def overlap(shift):
        """The best segment of one diagonal as (score, -begin, matched, length)."""
        first, last = F.greatest(F.lit(0), -shift), F.least(F.size("b"), F.size("a") - shift) - 1
        same = F.transform(F.sequence(first, last), lambda i: F.get("a", i + shift) == F.get("b", i))
        return F.aggregate(same, empty, step, lambda t: F.struct(  # the result is read once, so the fold runs once
            t["score"].cast("long").alias("score"), (-(first + shift + t["from"])).cast("long").alias("back"), t["matched"].cast("long").alias("matched"), (t["upto"] - t["from"]).cast("long").alias("length")))

    rows = whole.select("doc_id", "item_id", "enough", F.array_max(F.transform("shifts", overlap)).alias("t")).where(F.col("t.score") >= F.col("enough"))
    top = rows.groupBy("doc_id", "item_id").agg(F.max("t").alias("t"))  # rows that share a doc_id
    return top.select("doc_id", "item_id", (-F.col("t.back")).alias("begin"), "t.matched", "t.length", "t.score")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns; rows without doc_id stay."""
    found = store(find_leaks(docs, benchmark, **how).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
