"""Cases of the review of round 1, against brute force."""
import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from softbough.llm import decontaminate, queries, resharding, suffix_dedup, token_store


def test_hidden_matches(spark, monkeypatch):
    """A passage of 50 words that other documents hide by sharing longer contexts on one side only."""
    r = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    rows = []
    for trial in range(6):
        passage = fresh(50)
        a, b = fresh(45) + passage + fresh(45), fresh(45) + passage + fresh(45)
        rows += [(1000 * trial, a), (1000 * trial + 1, b)]
        for n in range(60):
            src, at = (a, b)[n % 2], int(r.integers(10, 80))
            rows.append((1000 * trial + 2 + n, fresh(20) + src[at : at + 49] + fresh(20)))
    seen = collections.defaultdict(set)
    for i, w in rows:
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].add(i)
    want = collections.defaultdict(set)
    for i, w in rows:
        for p in range(len(w) - 49):
            if len(seen[tuple(w[p : p + 50])]) > 1:
                want[i].update(range(p, p + 50))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    plain = suffix_dedup._bitmap
    for most in (27, 0):  # with bitmaps, and with joins in their place
        monkeypatch.setattr(suffix_dedup, "_bitmap", lambda keys: plain(keys, most))
        got = {x.doc_id: {z for s in x.spans for z in range(s.begin, s.end)} for x in suffix_dedup.repeated_spans(df).collect()}
        assert len(want) == 12 and got == dict(want)


def best_score(a, b):
    """Of all diagonals' segments: matches less twice the others."""
    top = 0
    for shift in range(1 - len(b), len(a)):
        run = 0
        for i in range(max(0, -shift), min(len(b), len(a) - shift)):
            run = max(0, run) + (1 if a[i + shift] == b[i] else -2)
            top = max(top, run)
    return top


def test_short_and_substituted_items(spark):
    r = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    items, docs = {}, {}
    for n, changed in ((1, ()), (2, ()), (4, ()), (5, ()), (9, ()), (9, (4,)), (11, (5,)), (12, (6,)), (15, (4, 9)), (16, (5, 10)), (59, range(4, 59, 5)), (59, range(3, 59, 4)), (20, range(1, 20, 2))):
        i = len(items)
        items[i] = fresh(n)
        docs[i] = fresh(30) + [f"x{i}" if p in changed else w for p, w in enumerate(items[i])] + fresh(30)
    for i in range(100, 160):
        items[i] = fresh(int(r.integers(10, 60)))
        docs[i] = fresh(9) + [w if r.random() > .25 else "x" for w in items[i]] + fresh(9)
    want = {}
    for i, b in items.items():
        score, n = best_score(docs[i], b), len(b)
        if score >= (n if n < 10 else min(10, -(-n * 6 // 10))):
            want[i] = (i, score)
    assert set(range(13)) - set(want) == {5, 12}
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(900, ""), (901, None), (902, " ")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(900, ""), (901, None), (902, " ")], "item_id long, text string")
    for limit in (10**6, 0):
        got = {x.doc_id: (x.item_id, x.score) for x in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, broadcast_rows=limit).collect()}
        assert got == want


def test_shards_are_written_and_read_back(spark, tmp_path):
    """Repeated rows, nulls and empties lie in the files at the planned places; op6 reads them from there."""
    texts = [None, "", "same", "same", *(f"text {i} " * (i % 40) for i in range(300))]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(7, texts[7], 1000 + i) for i in range(5)] + [(None, "same", 2000), (None, "same", 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    plan = resharding.BlockPlan(docs, F.pmod(F.xxhash64("text"), F.lit(4)), 5, 4)
    assert resharding.rewrite_affected(docs, plan, str(tmp_path / "shards")) == plan.affected != []
    got = resharding.read_shards(spark, str(tmp_path / "shards"), ["doc_id", "text", "n"]).collect()
    want = plan.slots().where(F.col("shard").isin(plan.affected)).collect()
    place = lambda r: (r.shard, r.slot, r.doc_id)
    assert collections.Counter(map(place, got)) == collections.Counter(map(place, want))
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert {(r.doc_id, r.text, r.n) for r in got} <= set(rows) and len({r.n for r in got}) == len(got)
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    out = queries.op6_sharding(spark, str(tmp_path / "sf"))
    assert "shards" in "".join(out.inputFiles())
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == len(rows) and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_copies_stay_together(spark):
    """Of equal texts, only a group too large to balance is spread over shards, whatever else its block holds."""
    texts = ["hot " * 50] * 900 + [f"group {g} " * 20 for g in range(60) for _ in range(12)] + [f"{i} " * (30 + i % 50) for i in range(600)] + ["long " * 2000] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = resharding.reshard(docs, F.pmod(F.xxhash64("text"), F.lit(4)), 6, 4, blocks=8).collect()
    shards, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[texts[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
    assert {t[:5] for t, s in shards.items() if len(s) > 1} == {"hot h"}
    assert max(sizes.values()) < 1.15 * sum(sizes.values()) / 6


def test_special_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    path = token_store.tokenizer_file()
    tok = Tokenizer.from_file(path)
    texts = ["a b <|endoftext|> c d", "<|endoftext|>", "x<|endoftext|>y  z", "plain words, here.", "<|endoftext", None, ""]
    segments, dictionary = token_store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_store(segments, dictionary, digest=True).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_posteriors_and_bound(spark):
    """Shrunk rates and bounds against the formulas in plain Python; bad hosts are blocked, those with a few bad pages are spared."""
    from softbough.llm import url_filter

    r = np.random.default_rng(8)
    hosts = {f"h{i}.site{i % 4}.{'com' if i % 3 else 'co.uk'}": (int(r.integers(5, 60)), 0.1) for i in range(30)}
    hosts |= {"spam.site1.com": (80, 0.9), "junk.bad.co.uk": (60, 0.8), "one.other.com": (1, 1.0), "two.fine.com": (3, 0.0)}
    pages, bad = [], []
    for h, (n, p) in hosts.items():
        for _ in range(n):
            pages.append((len(pages), f"https://{h.upper()}/x/{len(pages)}"))
            bad.append((len(bad), int(r.random() < p)))
    got = {x.host: x for x in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), rules=()).collect()}
    counts = {h: [0, 0] for h in hosts}
    for (i, u), (_, b) in zip(pages, bad):
        h = u.split("/")[2].lower()
        counts[h][0] += 1
        counts[h][1] += b
    suffix = {h: "co.uk" if h.endswith("co.uk") else "com" for h in hosts}
    domain = {h: ".".join(h.split(".")[1:]) for h in hosts}

    def add(of):
        out = collections.defaultdict(lambda: [0, 0])
        for h, (n, b) in counts.items():
            out[of[h]][0] += n
            out[of[h]][1] += b
        return out

    def shrink(level, prior):
        e, o, s = (sum(f(n, b, prior[x]) for x, (n, b) in level.items()) for f in (lambda n, b, m: n * m * (1 - m), lambda n, b, m: n * (b / n - m) ** 2, lambda n, b, m: m * (1 - m)))
        strength = 1 / min(max((o - s) / (e - s) if e != s else 0.01, 0.01), 0.1) - 1
        return {x: (b + strength * prior[x]) / (n + strength) for x, (n, b) in level.items()}, strength

    m0 = sum(b for _, b in counts.values()) / len(pages)
    m1, _ = shrink(add(suffix), {"com": m0, "co.uk": m0})
    m2, _ = shrink(add(domain), {d: m1["co.uk" if d.endswith("co.uk") else "com"] for d in domain.values()})
    rate, s = shrink(counts, {h: m2[domain[h]] for h in hosts})
    low = {h: rate[h] - 1.645 * (rate[h] * (1 - rate[h]) / (counts[h][0] + s + 1)) ** 0.5 for h in hosts}
    assert all(abs(got[h].rate - rate[h]) < 1e-6 and abs(got[h].low - low[h]) < 1e-6 for h in hosts)
    blocked = {h for h in hosts if got[h].verdict == "block"}
    assert blocked == {h for h in hosts if low[h] > m0} and {"spam.site1.com", "junk.bad.co.uk"} <= blocked and not {"one.other.com", "two.fine.com"} & blocked


def test_moved_bytes_and_odd_shards(spark):
    """Sizes are near equal and few more bytes move than must; rows of no old shard are placed."""
    r = np.random.default_rng(9)
    rows = [(i, "x" * int(r.integers(0, 400)) + str(i), [None, -1, 99][i % 3] if i % 10 == 0 else int(r.integers(0, 6) ** 2 // 8)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, o int").repartition(3)
    got = resharding.reshard(docs, F.col("o"), 5, 4).collect()
    sizes, supply, moved = collections.Counter(), collections.Counter(), 0
    for x in got:
        sizes[x.shard] += x.size
        supply[x.old_shard] += x.size
        moved += x.size * (x.old_shard != x.shard)
    total = sum(sizes.values())
    least = total - sum(min(supply[i], total / 5) for i in range(4))
    assert len(got) == len(rows) and set(supply) == {None, 0, 1, 2, 3}
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * total / 5 and moved < least + 0.02 * total


def test_names_that_clash(spark):
    from softbough.llm import line_dedup

    line = "A line of more than forty characters, in each of the documents."
    rows = [(i, f"{line}\nown {i}", "k", "d", 7) for i in range(6)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, __keep string, __doc string, n_lines int")).collect()
    assert {(x.doc_id, x.text, x["__keep"], x["__doc"], x.n_dropped) for x in got} == {(i, f"own {i}" if i < 5 else rows[i][1], "k", "d", int(i < 5)) for i in range(6)}


def test_store_of_narrow_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(7, "again"), (None, "x")], "doc_id long, text string")
    try:
        token_store.write_store(docs, token_store.tokenizer_file(), end=70_000)
        raise AssertionError("an id over 65 535 in two bytes")
    except ValueError:
        pass
    segments, dictionary = token_store.write_store(docs, token_store.tokenizer_file(), end=70_000, width="<u4")
    assert [x[-1] for x in token_store.read_document(segments, dictionary, 7)] == [70_000] * 2 and token_store.read_document(segments, dictionary, 99) == []


def test_threshold_by_quantile():
    """The threshold parts the fitted rows' scores at the share of label 0; with one class nothing is cut."""
    from softbough.llm import bt_quality

    r = np.random.default_rng(2)
    y = np.array([0] * 30 + [1] * 170)
    x = r.normal(size=(200, 2 * bt_quality.N_FEATURES - 1)) + 4 * y[:, None]
    model = bt_quality.fit_pairwise(x, y)
    scores = model.score(x)
    assert (scores < model.threshold).sum() == 30 and scores[y == 0].max() < model.threshold < scores[y == 1].min()
    assert bt_quality.fit_pairwise(x, np.ones(200)).threshold == 0


def test_grid_of_blocks(spark):
    from softbough.llm import block_ann

    r = np.random.default_rng(6)
    vecs = [(i, [float(v) for v in r.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(4)
    got = {(x.query_id, x.rank): x.vec_id for x in block_ann.nearest(df, F.col("vec_id") % 4 == 0, 5, 16, 20, 2).collect()}
    m = np.array([v for _, v in vecs])
    for q in range(0, 400, 4):
        s = [(-float(sum(a * b for a, b in zip(m[q], m[i]))), i) for i in range(400) if i != q]
        assert [got[q, k + 1] for k in range(5)] == [i for _, i in sorted(s)[:5]]


def test_many_near_copies_in_pieces(spark):
    """Long lists in pieces, a hub that links with few, a component apart in the same lists: components equal brute force."""
    from test_operators import brute_components, prose

    from softbough.llm import ngram_join

    base, other = prose(70, 100).split(), prose(71, 60).split()
    r = np.random.default_rng(70)
    rows = []
    for i in range(150):
        w = list(base)
        for p in r.integers(0, 100, int(r.integers(0, 5))):
            w[p] = f"x{i}y{p}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:60] + other[: 10 + i])) for i in range(40)] + [(300 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    for list_rows, short, heavy in ((40_000, 4, 3), (4_000_000, 1, 4096)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_jaccard_join(df, short=short, list_rows=list_rows, heavy=heavy).collect()}
        assert got == want
