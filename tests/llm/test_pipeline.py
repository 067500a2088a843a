"""Each stage of corpus_pipeline and run() against brute force on a small corpus."""
import pytest
from test_operators import brute_components, lower, prose, words

import corpus_pipeline as P

LINE = "Subscribe to our newsletter and never miss any of the stories again."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose, junk, a line shared by many, near copies, a leaked benchmark item, nulls, repeats and a clashing column."""
    d = tmp_path_factory.mktemp("sf")
    base, item = prose(900, 80), prose(901, 25)
    rows = [(i, prose(i, 60) + ("" if i % 2 else "\n" + LINE) + "\n" + prose(300 + i, 30)) for i in range(40)]
    rows += [(100 + i, " ".join(w + "$$$ ***" for w in prose(400 + i, 60).split())) for i in range(20)]
    rows += [(200 + i, base + f" tail{i}") for i in range(4)] + [(210, base), (220, f"{prose(902, 30)} {item} {prose(903, 30)}"), (230, None), (231, ""), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long")
    docs.repartition(3).write.parquet(str(d / "documents.parquet"))
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(15)]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, prose(904, 20)), (3, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    import sentencepiece

    from softbough.llm import piece_codec
    from softbough.llm._common import store, table

    d, rows = folder
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    docs = table(spark, d, "documents")
    got = store(stages["quality"](spark, docs, d), "t")
    ids = {r.doc_id for r in got.collect()}
    assert not ids & set(range(100, 120)) and {*range(40), *range(200, 204), 210, 220} <= ids and got.columns == P.COLUMNS
    now = kept(got)
    lines = store(stages["line_dedup"](spark, got, d), "t")
    want = sorted(((i, t if i == 38 or not t or LINE not in t else "\n".join(x for x in t.split("\n") if x != LINE)) for i, t in now), key=str)
    assert kept(lines) == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    near = store(stages["near_duplicates"](spark, lines, d), "t")
    comp = brute_components(want)
    assert kept(near) == sorted(((i, t) for i, t in want if comp[i][1] == i), key=str) and {i for i in comp if comp[i][1] != i} == {201, 202, 203, 210}
    clean = store(stages["decontamination"](spark, near, d), "t")
    assert kept(clean) == [x for x in kept(near) if x[0] != 220]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_file())
    last = {r.doc_id: r.ids for r in stages["sentencepiece"](spark, clean, d).collect()}
    assert last == {i: sp.encode(t or "") for i, t in kept(clean)}
    assert {r.doc_id: r.ids for r in P.run(spark, d).collect()} == last


def test_empty(spark, folder, tmp_path):
    d, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_words():
    assert words("A\tb") == ["a", "b"] and lower("\u00c4A") == "\u00c4a"
