"""Classes of failures, outcomes and warnings, and stops by budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPABILITIES = ("structured-output", "exact-excerpts")


def failure_kind(status: Column, code: Column, message: Column) -> Column:
    code = F.lower(F.coalesce(code, F.lit("")))
    timeout = code.contains("timeout") | F.lower(F.coalesce(message, F.lit(""))).contains("timeout")
    return (
        F.when(status.isin(401, 403) | code.contains("auth"), "authentication")
        .when((status == 429) | code.contains("rate"), "rate-limit")
        .when(timeout | (status == 408), "timeout")
        .when(code.contains("invalid_request") | status.between(400, 499), "invalid-request")
        .when((status >= 500) | code.contains("unavailable"), "unavailable")
        .otherwise("unknown")
    )


def retryable(kind: Column, declared: Column) -> Column:
    return F.coalesce(declared, kind.isin("rate-limit", "timeout", "unavailable"))


def failure(provider: Column, status: Column, code: Column, message: Column, declared: Column) -> Column:
    """Struct (provider, kind, retryable, message) of a call that failed."""
    kind = failure_kind(status, code, message)
    return F.struct(provider.alias("provider"), kind.alias("kind"), retryable(kind, declared).alias("retryable"), message.alias("message"))


def missing_capability(declared: list[str] | None, with_task: bool = False) -> str | None:
    """The first required capability that a provider declares but lacks; an undeclared list allows all."""
    needed = CAPABILITIES + (("task-specifications",) if with_task else ())
    return None if declared is None else next((c for c in needed if c not in declared), None)


def outcome(error: Column, partial_reason: Column, provider_failures: Column) -> Column:
    """Struct (status, category, code) of a result."""
    s = lambda a, b, c: F.struct(F.lit(a).alias("status"), b.alias("category"), c.alias("code"))
    none, fail = F.lit(None).cast("string"), "failure"
    capability = error.contains("does not support required capability")
    return (
        F.when(partial_reason.isNotNull(), s("partial", none, partial_reason))
        .when(error.isNull(), s("success", none, none))
        .when(F.startswith(error, F.lit("invalid taskSpec:")), s(fail, F.lit("invalid-task"), F.lit("invalid-task-spec")))
        .when(
            F.startswith(error, F.lit("invalid ")) | capability,
            s(fail, F.lit("invalid-config"), F.when(error.contains("capability"), "unsupported-provider-capability").otherwise("invalid-extract-config")),
        )
        .when(provider_failures > 0, s(fail, F.lit("provider"), F.lit("provider-failure")))
        .when(error.rlike("(?i)preparation|extraction failed|bytes are required|not implemented"), s(fail, F.lit("preparation"), F.lit("content-preparation-failure")))
        .otherwise(s(fail, F.lit("unexpected"), F.lit("unexpected-extraction-failure")))
    )


WARNINGS = [
    ("^stopped after ", "limit", "partial-stop"),
    ("^prepared artifact storage failed", "storage", "prepared-artifact-storage-failed"),
    ("provider call failed|^response truncated|^provider returned", "provider", "provider-warning"),
    ("^dropped .*proposal|^clamped |normalization failed", "normalization", "proposal-normalization"),
    ("beyond maxChunks", "limit", "content-truncated"),
    ("chunked into", "content", "content-chunking"),
    ("(?i)OCR|pdfLayout|js-shell|extractor-reported|embedded-state|markdown preparation", "preparation", "content-preparation-warning"),
]


def warning_class(warning: Column) -> Column:
    """Struct (category, code) of a warning."""
    out = None
    for pattern, category, code in WARNINGS:
        value = F.struct(F.lit(category).alias("category"), F.lit(code).alias("code"))
        out = F.when(warning.rlike(pattern), value) if out is None else out.when(warning.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit("other").alias("category"), F.lit("unclassified-warning").alias("code")))


def budget_stops(calls: DataFrame, max_calls: int, max_tokens: int) -> DataFrame:
    """Replay of sequential dispatch: of `calls` (run_id, chunk_idx, tokens), per run what was done before a ceiling stopped it.

    A call is made if fewer than max_calls were, and fewer than max_tokens tokens used, before it. (run_id, completed, remaining, tokens_used, reason, token_overshoot).
    """
    before = W.partitionBy("run_id").orderBy("chunk_idx").rowsBetween(W.unboundedPreceding, -1)
    place = F.row_number().over(W.partitionBy("run_id").orderBy("chunk_idx"))
    rows = calls.withColumn("__made", (place <= max_calls) & (F.coalesce(F.sum("tokens").over(before), F.lit(0)) < max_tokens))
    made = F.col("__made")
    agg = rows.groupBy("run_id").agg(
        F.sum(made.cast("int")).alias("completed"), F.sum((~made).cast("int")).alias("remaining"),
        F.coalesce(F.sum(F.when(made, F.col("tokens"))), F.lit(0)).alias("tokens_used"),
    )
    reason = F.when(F.col("remaining") == 0, F.lit(None)).when(F.col("completed") >= max_calls, "max-provider-calls").otherwise("max-total-tokens")
    over = F.when((F.col("remaining") > 0) & (F.col("tokens_used") > max_tokens), F.col("tokens_used") - max_tokens)
    return agg.withColumn("reason", reason).withColumn("token_overshoot", over)
