"""Span-level evaluation of proposals against gold, per case and in total, and merging of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import nth_occurrence, u16_length, u16_offset

KEY, VALUE = ("field_path", "value_canon", "locator"), ("field_path", "value_canon")


def gold_locators(gold: DataFrame) -> DataFrame:
    """`gold` (..., text, excerpt, occurrence from 1) with `locator`; occurrences don't overlap here."""
    at = u16_offset(F.col("text"), nth_occurrence(F.col("text"), F.col("excerpt"), F.col("occurrence")))
    return gold.withColumn("__at", at).withColumn(
        "locator", F.concat(F.lit("chars:"), F.col("__at").cast("string"), F.lit("-"), (F.col("__at") + u16_length(F.col("excerpt"))).cast("string"))
    ).drop("__at")


def type_valid(kind: Column, json: Column, enum_values: Column) -> Column:
    """Whether a JSON value is of a declared type; dates are any text."""
    v = F.try_parse_json(json)
    shape = F.schema_of_variant(v)
    text = shape == "STRING"
    return (
        F.when(kind == "number", shape.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        .when(kind == "boolean", shape == "BOOLEAN")
        .when(kind == "array", F.startswith(shape, F.lit("ARRAY")))
        .when(kind == "object", F.startswith(shape, F.lit("OBJECT")))
        .when(kind == "enum", text & (enum_values.isNull() | F.array_contains(enum_values, F.get_json_object(json, "$"))))
        .otherwise(text)
    )


def exactly_grounded(text: Column, locator: Column, excerpt: Column) -> Column:
    from gristmill.functions.text import u16_slice

    s, e = (F.regexp_extract(locator, r"^chars:(\d+)-(\d+)$", k).try_cast("int") for k in (1, 2))
    return F.coalesce(u16_slice(text, s, e) == excerpt, F.lit(False))


def _counts(proposals: DataFrame, gold: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """(case_id, <name>_found, _wanted, _both): sizes of the two sets of keys and of what both have, by one aggregation."""
    p = proposals.select("case_id", *keys, F.lit(1).alias("p"), F.lit(0).alias("g"))
    g = gold.select("case_id", *keys, F.lit(0).alias("p"), F.lit(1).alias("g"))
    sets = p.unionByName(g).groupBy("case_id", *keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return sets.groupBy("case_id").agg(
        F.sum("p").alias(f"{name}_found"), F.sum("g").alias(f"{name}_wanted"), F.sum(F.col("p") * F.col("g")).alias(f"{name}_both")
    )


def case_metrics(cases: DataFrame, proposals: DataFrame, gold: DataFrame, schema: DataFrame | None = None, texts: DataFrame | None = None, none_found: float | None = None) -> DataFrame:
    """Of each of `cases` (case_id, offered, maybe calls, tokens, failures): precision, recall, value_accuracy, grounded_drop_rate, schema_coverage.

    With `schema` (path, type, enum_values), and value_json in `proposals`: type_validity. With `texts` (case_id, text), and excerpt in `proposals`: false_grounding_rate. `none_found`: the
    precision of a case without proposals; None: 1 if nothing was wanted, else 0.
    """
    out = cases
    for keys, name in ((KEY, "span"), (VALUE, "value"), (("field_path",), "path")):
        out = out.join(_counts(proposals, gold, keys, name), "case_id", "left")
    number = [F.count(F.lit(1)).alias("n")]
    rows = proposals
    if schema is not None:
        fields = schema.select(F.col("path").alias("field_path"), F.col("type").alias("value_kind"), "enum_values").dropDuplicates(["field_path"])
        rows = rows.drop("enum_values").join(fields, "field_path", "left")
        valid = F.when(F.col("value_kind").isNull(), False).otherwise(type_valid(F.col("value_kind"), F.col("value_json"), F.col("enum_values")))
        number.append(F.sum(F.coalesce(valid, F.lit(False)).cast("int")).alias("n_valid"))
    if texts is not None:
        rows = rows.join(texts.select("case_id", F.col("text").alias("case_text")), "case_id", "left")
        number.append(F.sum((~exactly_grounded(F.col("case_text"), F.col("locator"), F.col("excerpt"))).cast("int")).alias("n_false"))
    out = out.join(rows.groupBy("case_id").agg(*number), "case_id", "left").fillna(0)
    c = F.col

    def share(a: str, b: str, empty) -> Column:
        return F.when(c(b) == 0, empty).otherwise(c(a) / c(b))

    nothing = F.when(c("span_wanted") == 0, 1.0).otherwise(0.0) if none_found is None else F.lit(none_found)
    return out.select(
        "case_id",
        F.when(c("span_found") == 0, nothing).otherwise(c("span_both") / c("span_found")).alias("precision"),
        share("span_both", "span_wanted", F.lit(1.0)).alias("recall"),
        share("value_both", "value_wanted", F.lit(1.0)).alias("value_accuracy"),
        F.when(c("offered") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (c("offered") - c("n")) / c("offered"))).alias("grounded_drop_rate"),
        share("path_both", "path_wanted", F.lit(1.0)).alias("schema_coverage"),
        *([share("n_valid", "n", F.lit(1.0)).alias("type_validity")] if schema is not None else []),
        *([share("n_false", "n", F.lit(0.0)).alias("false_grounding_rate")] if texts is not None else []),
        *[x for x in ("calls", "tokens", "failures") if x in cases.columns],
    )


def summary(metrics: DataFrame) -> DataFrame:
    """The number of cases, means of the rates and sums of calls, tokens and failures."""
    rates = [m for m in ("precision", "recall", "value_accuracy", "grounded_drop_rate", "schema_coverage", "type_validity", "false_grounding_rate") if m in metrics.columns]
    return metrics.agg(F.count(F.lit(1)).alias("cases"), *[F.avg(m).alias(m) for m in rates], *[F.sum(m).alias(m) for m in ("calls", "tokens", "failures") if m in metrics.columns])


def proposal_identity(field_path: Column, value_canon: Column, locator: Column, proposal: Column) -> Column:
    """Struct (merge_key_digest, proposal_digest): of the key by which passes merge, and of the whole proposal as JSON."""
    return F.struct(
        F.sha2(F.concat_ws(chr(0), field_path, value_canon, locator), 256).alias("merge_key_digest"), F.sha2(F.to_json(proposal), 256).alias("proposal_digest")
    )


def typed_failure(message: Column) -> Column:
    """The code of a warning or error of a run with budgets."""
    return (
        F.when(message.rlike("unknown fieldPath"), "unknown-field")
        .when(message.rlike("excerpt not found"), "ungrounded-excerpt")
        .when(message.rlike("maxProviderCalls"), "max-provider-calls")
        .when(message.rlike("maxTotalTokens"), "max-total-tokens")
        .otherwise("provider-or-runtime-warning")
    )


def passes(run, number: int, max_calls: int, max_tokens: int) -> tuple[list, dict]:
    """(runs, budget): up to `number` passes over a case, while calls and tokens are left.

    `run(pass, calls left, tokens left, proposals so far)` gives a dict (proposals, provider_calls, total_tokens_used).
    """
    done, calls, tokens = [], 0, 0
    for k in range(number):
        if calls >= max_calls or tokens >= max_tokens:
            break
        got = run(k, max_calls - calls, max_tokens - tokens, [p for r in done for p in r["proposals"]])
        calls, tokens = calls + got["provider_calls"], tokens + got["total_tokens_used"]
        done.append(got)
    return done, {"attempts": len(done), "calls": calls, "tokens": tokens, "token_overshoot": max(0, tokens - max_tokens), "later_pass_skipped": len(done) < number}


def failure_code(message: Column) -> Column:
    return (
        F.when(message.rlike("unknown fieldPath"), "unknown-field")
        .when(message.rlike("excerpt not found"), "ungrounded-excerpt")
        .when(message.rlike("duplicate proposal"), "duplicate-proposal")
        .when(message.rlike("chunked into"), "chunked-input")
        .otherwise("provider-or-runtime-warning")
    )


def merged_passes(proposals: DataFrame, key: tuple[str, ...] = ("run_id", *KEY)) -> DataFrame:
    """The ordered exact union of passes: of equal keys the first by (pass, seq)."""
    rank = W.partitionBy(*key).orderBy("pass", "seq")
    return proposals.withColumn("__k", F.row_number().over(rank)).where("__k = 1").drop("__k")
