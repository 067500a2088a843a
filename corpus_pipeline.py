"""A corpus pipeline of five stages; each takes what its predecessor kept.

Columns are those of documents (doc_id, text, lang, source, n_chars) up to the last stage, which returns ids. A stage never
changes doc_id; line dedup rewrites text and n_chars. A stage's table is deleted when the next one is written. Null or empty texts pass the quality stage by their score like any other, have no
lines to drop, link with nothing, hold no benchmark passage and encode to no ids; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softbough.llm import bt_quality, decontaminate, line_dedup, ngram_join, piece_codec
from softbough.llm._common import discard, store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score at or above the model's quantile threshold stay (higher: quality label 1 likelier)."""
    model = bt_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = bt_quality.score_quality(docs.select(COLUMNS), model)
    return scored.where(F.col("score") >= model.threshold).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold stay in the largest doc_id only."""
    kept = line_dedup.dedup_lines(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component stays."""
    linked = ngram_join.ngram_jaccard_join(docs)
    gone = store(linked.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids): the whole text in SentencePiece ids."""
    return piece_codec.encode_pieces(docs, piece_codec.model_file(), ["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("sentencepiece", pieces)]
#: Learned scores and tokenization can't be said in SQL; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
