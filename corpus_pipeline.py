"""A corpus pipeline of five operators: each stage takes all that the one before it kept.

In every stage null and empty texts and rows of null doc_id stay (toxicity judges the text of a null doc_id like any other), very long texts are read whole, repeated rows are decided alike,
columns of any name go along, and an empty table gives an empty table. What a stage writes on the way is removed when the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontam, jaccard, mixing, sharding, toxicity
from gristmill.llm.common import mark, release, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labelled ones, rejects go; without labels of both classes none does, and an id labelled both ways teaches nothing."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    sample = toxicity.training_sample(table(spark, sf_dir, "documents", "doc_id", "text"), labels)
    return toxicity.drop_toxic(docs, toxicity.train(sample))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays, that of the least doc_id; rows without tokens are in no class, rows that repeat a doc_id stay or go together."""
    return jaccard.drop_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; items without tokens are in no document, and without items all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the same amount of text asks; a null source is one of its own, and a source without any text goes."""
    return mixing.mix_sources(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard, by doc_id; null is one key, and repeats of a key share a shard."""
    return sharding.consistent_shards(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The toxicity stage is a trained machine, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written to the shared folder for the next one. The result reads what the last but one wrote."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        release(spark, start, mark() - 1)
        start, docs = mark() - 1, kept
    return STAGES[-1][1](spark, docs, sf_dir)
