"""Streams over growing folders of snapshots and ledger events; the operators are those of the batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ledger import EVENTS, reservations
from gristmill.sources.snapshots import SCHEMA


def snapshot_stream(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Snapshots as they arrive, unchanged re-captures of a source left out within the watermark."""
    rows = spark.readStream.schema(SCHEMA.replace("body_bytes binary", "body_bytes string")).json(folder)
    timed = rows.withColumn("fetched_ts", F.try_to_timestamp("fetched_at")).withWatermark("fetched_ts", late)
    return timed.dropDuplicatesWithinWatermark(["source_id", "body_hash"])


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """What each reservation counts for so far, updated with every event: the first of the two aggregations of `totals`."""
    return reservations(spark.readStream.schema(EVENTS).json(folder))


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reservations' raw facts of two disjoint sets of events, put together: each is a sum, a maximum or the events themselves."""
    from pyspark.sql import functions as F

    both = old.unionByName(new)
    return both.groupBy("authorization_digest", "reservation_id").agg(
        F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.max("state").alias("state"), F.max("reserved").alias("reserved"), F.max("usage").alias("usage")
    )


def ledger_totals_stream(spark: SparkSession, folder: str, sink, checkpoint: str):
    """A query that hands `sink` the totals of all events so far after each micro-batch; start and stop are the caller's.

    The state is a table of one row a reservation beside the checkpoint: a batch's events are folded into it, so that its cost is that of the batch and of the reservations, not of all events again. A
    batch that Spark repeats finds the state of the one before it.
    """
    from gristmill.operators.ledger import facts, totals_of

    def state(epoch: int) -> str:
        return f"{checkpoint.rstrip('/')}-state/{epoch}"

    def remove(path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def each(batch: DataFrame, epoch: int) -> None:
        now = facts(batch)
        if epoch and exists(state(epoch - 1)):
            now = _merged(spark.read.parquet(state(epoch - 1)), now)
        now.write.mode("overwrite").parquet(state(epoch))
        sink(totals_of(spark.read.parquet(state(epoch))), epoch)
        if epoch > 1:
            remove(state(epoch - 2))

    return spark.readStream.schema(EVENTS).json(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
