"""The queries of the llm operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontam, jaccard, licenses, lines, mixing, scoring, sharding, toxicity
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.consistent_shards(table(spark, sf_dir, "documents", "doc_id", "source", "n_chars"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix_sources(docs, numbered=True).drop("text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20, against all rows."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, queries=vectors.where("vec_id % 20 = 0"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sample = toxicity.training_sample(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_toxicity(docs, toxicity.train(sample))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_line_dedup": op2_line_dedup,
    "op3_consistent_sharding": op3_consistent_sharding,
    "op4_source_mixing": op4_source_mixing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
}

ORACLES = {
    "op2_line_dedup": lines.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op6_ngram_jaccard_join": jaccard.ORACLE,
    "op7_decontamination": decontam.ORACLE,
}
