"""Operators against brute force on small tables with nulls, empties, ties, repeats and clashing column names."""
import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from softbough.llm import block_ann, bt_quality, decontaminate, line_dedup, ngram_join, piece_codec, resharding, suffix_dedup, token_store, url_filter

WHITE = r"[\x20\x09-\x0d]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(t):
    return [w for w in re.split(WHITE, lower(t or "")) if w]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, shared, line = prose(1, 120), prose(2, 55), "This line of more than forty characters stands in many documents."
    out = [(0, base), (1, base), (2, base + " more"), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE  two"), (9, prose(3, 3000))]
    out += [(10 + i, f"{prose(50 + i, 60)}\n{line}\n{prose(90 + i, 40)}") for i in range(7)]
    out += [(30 + i, f"{prose(130 + i, 40)} {shared} {prose(170 + i, 40)}") for i in range(2)]
    w = base.split()
    out += [(40 + i, " ".join(w[:50] + [f"x{i}"] + w[51:])) for i in range(9)]  # near copies
    out += [(60, "naïve  ▁ text\x0btab  end ퟿"), (61, "日本語 " * 5), (62, "x\n\n\ny\r\n"), (63, "\n".join([line] * 3)), (10, out[10][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "n", "component_id", 0) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, n string, component_id string, score int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def brute_components(rows, num=75):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("short", [1, 4])
def test_ngram_join(docs, rows, short):
    got = ngram_join.ngram_jaccard_join(docs, short=short).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_suffix_dedup(docs, rows):
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    want = collections.defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                want[i].update(range(k, k + 50))
    got = {r.doc_id: {z for s in r.spans for z in range(s.begin, s.end)} for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == dict(want)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://b.example.com/de/", "http://x.org/fr/1", "https://n.net", "ftp://h.uk?x/y", "http://bad.biz/1", "http://bad.biz/2", "http://bad.biz/2"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(8, 1), (9, 1), (10, 1), (3, 0), (4, 0), (99, 1), (5, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert got[0] == ("", "", None, "allow") and got[2][:2] == ("", "")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][2:] == ("example.com/de/", "block")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][:3] == ("n.net", "", None) and got[7][:2] == ("h.uk", "")
    assert len(got) == len(urls)
    assert url_filter.filter_urls(pages.limit(0), outcomes.limit(0)).count() == 0


def test_decontaminate(spark, docs, rows):
    item = prose(500, 30)
    changed = item.split()
    changed[12] = "other"
    more = spark.createDataFrame([(100, f"{prose(501, 50)} {item} {prose(502, 50)}"), (101, prose(503, 20) + " " + " ".join(changed)), (102, prose(504, 80)), (None, item)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    for limit in (10**6, 0):
        got = {r.doc_id: (r.item_id, r.begin, r.matched, r.length) for r in decontaminate.find_leaks(all_docs, bench, broadcast_rows=limit).collect()}
        assert got == {100: (1, 50, 30, 30), 101: (1, 20, 29, 30)}
    left = decontaminate.drop_contaminated(all_docs, bench)
    assert left.count() == all_docs.count() - 2
    assert decontaminate.find_leaks(all_docs.limit(0), bench.limit(0)).count() == 0


def test_pieces(docs, rows):
    import sentencepiece

    path = piece_codec.model_file()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_codec.encode_pieces(docs, path, ["doc_id", "n", "text"])
    for r in piece_codec.decode_pieces(got, path, ["doc_id", "text", "ids"]).collect():
        assert r.ids == sp.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert got.count() == len(rows)


def test_reshard(docs, rows):
    got = resharding.reshard(docs, F.pmod(F.xxhash64("text"), F.lit(4)), 5, 4).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == sizes


def test_flow_is_least():
    flow = resharding.min_cost_flow([5, 7, 0], [4, 4, 4], lambda i, j: 0.0 if i == j else 1.0)
    assert flow.sum(1).tolist() == [5, 7, 0] and flow.sum(0).tolist() == [4, 4, 4] and flow.trace() == 8


def test_token_store(docs, rows):
    from tokenizers import Tokenizer

    path = token_store.tokenizer_file()
    tok = Tokenizer.from_file(path)
    segments, dictionary = token_store.write_store(docs, path)
    got = token_store.read_store(segments, dictionary, digest=True).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == start
        start += r.n_tokens
    assert token_store.read_document(segments, dictionary, 7)[0].tolist() == tok.encode("one two").ids + [2]


def test_nearest(spark):
    r = np.random.default_rng(5)
    vecs = [(i, list(map(float, r.normal(size=8).astype(np.float32)))) for i in range(300)]
    vecs += [(i, vecs[3][1]) for i in range(300, 340)]
    odd = [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (420, [1.0, None] * 4), (None, vecs[0][1])]
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for x in block_ann.nearest(df, F.col("vec_id") % 20 == 0, 20, 8, 32, 4).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    for q, v in vecs:
        if q % 20 == 0:
            scores = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in vecs if i != q)
            assert [round(s, 9) for _, _, s in sorted(got[q])] == [round(-s, 9) for s, _ in scores[:20]]
    assert len(got) == 17 and 300 in got and [i for _, i, _ in sorted(got[300])][0] == 3


def test_lines(docs, rows):
    where = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            key = lower(x.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 40:
                where[key].add(i)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(where.get(k := lower(x.strip(" \t\n\x0b\x0c\r")), ())) >= 5 and max(where[k]) != r.doc_id)]
        assert (r.text or "", r.n_lines, r.n_dropped) == ("\n".join(keep), len(lines), len(lines) - len(keep))


def test_quality(spark, docs, none):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "$$$ ***" for w in prose(i, 60).split())) for i in range(120)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(90, None), (999, 1), (1, 1)], "doc_id long, quality int")
    model = bt_quality.train(df, labels)
    got = {r.doc_id: r.score for r in bt_quality.score_quality(df, model).collect()}
    assert len(got) == 122 and all(0 <= s <= 1 for s in got.values())
    held = [got[i] for i in range(90, 120)]
    assert min(s for i, s in zip(range(90, 120), held) if i % 3) > max(s for i, s in zip(range(90, 120), held) if not i % 3)
    flat = bt_quality.train(none, labels)
    assert bt_quality.score_quality(none, flat).count() == 0


def test_empty_tables(none):
    assert ngram_join.ngram_jaccard_join(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert resharding.reshard(none, F.lit(0), 3, 2).count() == 0
    assert piece_codec.piece_digest(none, piece_codec.model_file()).count() == 0
    assert token_store.read_store(*token_store.write_store(none, token_store.tokenizer_file()), digest=True).count() == 0
    vectors = none.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    assert block_ann.nearest(vectors, F.lit(True)).count() == 0




def test_wide_signatures():
    """Signatures of unlike widths fold to the narrower one, and never show more differing bits than there are elements apart."""
    r = np.random.default_rng(5)
    u = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    for n in (1000, 1024, 1025, 1900, 2048, 2049, 2990):
        v = u[r.permutation(len(u))[:n]]
        x, y = (np.frombuffer(ngram_join.signature(s), np.uint64) for s in (u, v))
        w = min(len(x), len(y))
        assert len(x) * 64 >= len(u) and len(y) * 64 >= n
        assert np.bitwise_count(ngram_join.fold(x, w) ^ ngram_join.fold(y, w)).sum() <= len(u) - n


def test_long_near_copies(spark):
    base, rows = prose(7, 4100).split(), []
    for i, n in enumerate((4100, 4000, 3200, 3079, 3070, 2100, 2040, 1100, 1020)):
        rows.append((i, " ".join(base[:n])))
    rows += [(20 + i, " ".join(base[:300]) + " " + prose(700 + i, 2000)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert got == brute_components(rows)


def test_long_units_and_cuts(spark):
    """Texts without spaces, of one character or many, have the library's ids; what no piece holds side by side parts units."""
    import sentencepiece

    path = piece_codec.model_file()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = np.random.default_rng(3)
    texts = ["a" * 3000, "ab" * 1500, "".join(r.choice(list("etaoinshr"), 4000)), "x,y.z;" * 300, "日本語テスト" * 200, "a\0b\0\0c" * 50, "-" * 2500 + "end", "1234567890" * 100, "naïve,très.bon!", "😀" * 40, " lead", "trail ", "two  spaces"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {x.doc_id: x.ids for x in piece_codec.encode_pieces(df, path, ["doc_id"]).collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}
    parts, times = piece_codec.cut_units(["▁word,", "▁a"], piece_codec.load(path))
    assert parts == ["▁word", ",", "▁a"] and times.tolist() == [2, 1]
