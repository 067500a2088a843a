"""The driver's queries on the operators, and their SQL where SQL can express them."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_ann, bt_quality, decontaminate, line_dedup, ngram_join, piece_codec, resharding, suffix_dedup, token_store, url_filter
from ._common import shared_dir, table
from .oracles import SQL  # noqa: F401


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in words as text, begin-end with the end behind the last word."""
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ","))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number is in its path; that document's quality label is the page's outcome: 0 is a bad one."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = url_filter.parse(pages.select("page_id", "url")).select("page_id", F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) as long)").alias("doc_id"))
    outcomes = shown.join(labels, "doc_id").select("page_id", (1 - F.col("quality")).alias("bad"))
    return url_filter.filter_urls(pages, outcomes)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digest(table(spark, sf_dir, "documents"), piece_codec.model_file())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shards hold rows by their text's hash; law `bytes` over 24 new ones. Shard and slot are read from the files written."""
    old = F.pmod(F.xxhash64(F.lit("old"), "text"), F.lit(16))
    docs = table(spark, sf_dir, "documents")
    plan = resharding.BlockPlan(docs, old)
    path = f"{shared_dir(spark)}/softbough-shards-{uuid.uuid4().hex}"
    placed = plan.slots().where(~F.col("shard").isin(plan.affected))  # files that stay as they are
    if resharding.rewrite_affected(docs, plan, path):
        back = resharding.read_shards(spark, path, ["doc_id", "text"])
        size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + plan.overhead).cast("long"), F.crc32(F.coalesce("text", F.lit("")))
        placed = placed.unionByName(back.select("doc_id", size.alias("size"), crc.alias("text_crc32"), old.cast("int").alias("old_shard"), "shard", "slot"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, dictionary = token_store.write_store(table(spark, sf_dir, "documents"), token_store.tokenizer_file())
    return token_store.read_store(segments, dictionary, digest=True)


def op8_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bt_quality.train(docs, table(spark, sf_dir, "labels").where(~held))
    scored = bt_quality.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_url_filters, op4_benchmark_decontamination, op5_sentencepiece,
    op6_sharding, op7_token_store, op8_block_ann, op9_line_dedup, op10_quality_classifier,
)}
