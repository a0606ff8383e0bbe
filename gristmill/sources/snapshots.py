"""Snapshots of fetched pages: an append-only table, and what is read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.urls import resource, snapshot_ref, source_directory

SCHEMA = (
    "source_id string, url string, fetched_at string, status int, content_type string, body string, body_bytes binary, body_hash string, "
    "redirects array<string>, from_cache boolean, etag string, last_modified string, not_modified boolean, rendered boolean"
)


def body_hash(body: Column, body_bytes: Column) -> Column:
    return F.coalesce(F.sha2(body_bytes, 256), F.sha2(body, 256))


def put(snapshots: DataFrame, folder: str) -> None:
    """Append, partitioned by source directory; bytes as base64 text, as JSON holds them."""
    rows = snapshots.withColumn("source_key", source_directory(F.col("source_id")))
    rows.withColumn("body_bytes", F.base64("body_bytes")).write.mode("append").partitionBy("source_key").json(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All well-formed snapshots of a folder; foreign and corrupt records are left out."""
    text = SCHEMA.replace("body_bytes binary", "body_bytes string")
    rows = spark.read.schema(f"{text}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    return well_formed(rows.where("_corrupt_record is null").drop("_corrupt_record", "source_key")).withColumn("body_bytes", F.unbase64("body_bytes"))


def well_formed(rows: DataFrame) -> DataFrame:
    needed = ("source_id", "url", "fetched_at", "status", "content_type", "body_hash")
    test = F.lit(True)
    for c in needed:
        test = test & F.col(c).isNotNull()
    return rows.where(test)


def _newest():
    return W.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("body_hash"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest of each source: by the time as text, then by hash."""
    return snapshots.withColumn("__k", F.row_number().over(_newest())).where("__k = 1").drop("__k")


def by_prefix(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """For `wanted` (source_id, prefix), the newest snapshot whose hash begins so."""
    hits = snapshots.join(wanted, "source_id").where(F.startswith("body_hash", "prefix"))
    rank = W.partitionBy("source_id", "prefix").orderBy(F.desc("fetched_at"), F.desc("body_hash"))
    return hits.withColumn("__k", F.row_number().over(rank)).where("__k = 1").drop("__k")


def listed(snapshots: DataFrame) -> DataFrame:
    """All, with `place` from 1 for the newest of a source."""
    return snapshots.withColumn("place", F.row_number().over(_newest()))


def replayed(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For `requests` (source_id, ...), the latest snapshot as if from a cache, or `error` no-snapshot."""
    return requests.join(latest(snapshots).withColumn("from_cache", F.lit(True)), "source_id", "left").withColumn(
        "error", F.when(F.col("body_hash").isNull(), "no-snapshot")
    )


def conditional(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Validators to send with `requests` (source_id, url, revalidate): those of the latest snapshot, if it is of the same resource."""
    prior = latest(snapshots).select("source_id", F.col("url").alias("p_url"), F.col("etag").alias("p_etag"), F.col("last_modified").alias("p_modified"))
    same = F.coalesce(F.col("revalidate"), F.lit(False)) & (resource(F.col("url")) == resource(F.col("p_url")))
    return requests.join(prior, "source_id", "left").select(
        *requests.columns, F.when(same, F.col("p_etag")).alias("if_none_match"), F.when(same, F.col("p_modified")).alias("if_modified_since")
    )


def with_refs(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn(
        "snapshot_ref", snapshot_ref(F.col("source_id"), F.col("url"), F.col("body_hash"), F.col("fetched_at"))
    )
