"""A budget ledger of append-only events: reservations, settlements and totals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

SETTLED = tuple("aborted completed failed locally-rejected".split())
AMOUNTS = ("input_tokens", "output_tokens", "spend_usd")
EVENTS = "event string, authorization_digest string, reservation_id string, recorded_at string, reserved struct<input_tokens:bigint,output_tokens:bigint,spend_usd:double>, usage struct<input_tokens:bigint,output_tokens:bigint,spend_usd:double>"


def facts(events: DataFrame) -> DataFrame:
    """One row a reservation: how often it started and ended, its last state and its amounts. Facts of disjoint sets of events can be put together."""
    started = F.col("event") == "started"
    return events.groupBy("authorization_digest", "reservation_id").agg(
        F.sum(started.cast("int")).alias("starts"),
        F.sum((~started).cast("int")).alias("ends"),
        F.max(F.when(~started, F.col("event"))).alias("state"),
        F.max(F.when(started, F.col("reserved"))).alias("reserved"),
        F.max(F.when(~started, F.col("usage"))).alias("usage"),
    )


def reservations(events: DataFrame) -> DataFrame:
    """One row a reservation: what it counts for, by its last state, and `problem` where the events contradict each other.

    A single aggregation by reservation replaces the self-join of starts with settlements.
    """
    return counted(facts(events))


def counted(rows: DataFrame) -> DataFrame:
    key = ["authorization_digest", "reservation_id"]
    problem = F.when(F.col("starts") == 0, "settlement precedes reservation").when((F.col("starts") > 1) | (F.col("ends") > 1), "duplicate reservation state")
    amounts = {}
    for a in AMOUNTS:
        held, used = F.coalesce(F.col(f"reserved.{a}"), F.lit(0)), F.coalesce(F.col(f"usage.{a}"), F.lit(0))
        amounts[a] = (
            F.when(F.col("state").isNull(), held).when(F.col("state") == "locally-rejected", 0).when(F.col("state") == "completed", used).otherwise(F.greatest(held, used))
        )
    calls = F.when(F.coalesce(F.col("state"), F.lit("")) == "locally-rejected", 0).otherwise(1)
    return rows.select(*key, F.coalesce("state", F.lit("started")).alias("state"), calls.alias("calls"), *[amounts[a].alias(a) for a in AMOUNTS], problem.alias("problem"))


def totals(events: DataFrame) -> DataFrame:
    """Of each authorization, what counts against its ceilings."""
    return totals_of(facts(events))


def totals_of(rows: DataFrame) -> DataFrame:
    return counted(rows).groupBy("authorization_digest").agg(
        F.sum("calls").alias("provider_calls"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("spend_usd").alias("spend_usd"),
        *[F.sum((F.col("state") == s).cast("int")).alias(s.replace("-", "_")) for s in ("started", *SETTLED)],
    )


def admitted(requests: DataFrame, max_calls: int, max_tokens: int, max_spend: float) -> DataFrame:
    """`requests` (authorization_digest, seq, input_tokens, output_tokens, spend_usd) with `admitted`: in order, those that keep within all three ceilings.

    A refused request takes nothing; an amount that isn't given is none. The fold over an authorization's requests is sequential by nature, so an authorization is in one task, which
    sorts them, on disk if need be, and holds no more than the totals so far and a batch.
    """
    key = ["authorization_digest", "seq"]
    columns = key + [c for c in requests.columns if c not in key]
    none = F.lit(0)
    tokens = (F.coalesce("input_tokens", none) + F.coalesce("output_tokens", none)).cast("bigint")
    rows = requests.select(*columns, tokens.alias("__tokens"), F.coalesce("spend_usd", none).cast("double").alias("__spend"))
    rows = rows.repartition("authorization_digest").sortWithinPartitions("authorization_digest", F.col("seq").cast("bigint"), "__tokens", "__spend")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, calls, used, spent = None, 0, 0, 0.0
        for batch in batches:
            out = []
            for who, n, usd in zip(batch.column(0).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()):
                if who != whose:
                    whose, calls, used, spent = who, 0, 0, 0.0
                ok = calls < max_calls and used + n <= max_tokens and spent + usd <= max_spend + 1e-12
                if ok:
                    calls, used, spent = calls + 1, used + n, spent + usd
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out, pa.bool_())], names=[*columns, "admitted"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(columns)], StructField("admitted", BooleanType())]))


def settled(ledger: DataFrame, settlements: DataFrame) -> DataFrame:
    """`settlements` (event, authorization_digest, reservation_id, usage, ...) with `problem`, null for those that may be appended to the `ledger`.

    The status must be known, amounts not negative, and the reservation started exactly once and not settled; of several for one, none may.
    """
    key = ["authorization_digest", "reservation_id"]
    before = ledger.groupBy(*key).agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("event") == "started").cast("int")).alias("starts"))
    times = settlements.groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    usage = [F.coalesce(F.col(f"usage.{a}"), F.lit(0)) for a in AMOUNTS]
    problem = (
        F.when(~F.col("event").isin(*SETTLED), "status must be completed, failed, aborted, or locally-rejected")
        .when((usage[0] < 0) | (usage[1] < 0) | (usage[2] < 0), "amounts must not be negative")
        .when(~F.coalesce((F.col("events") == 1) & (F.col("starts") == 1) & (F.col("times") == 1), F.lit(False)), "reservation is missing or already settled")
    )
    rows = settlements.join(before, key, "left").join(times, key, "left")
    return rows.select(*settlements.columns, problem.alias("problem"))
