"""From proposals to grounded, deduplicated spans.

A proposal is kept only if its excerpt occurs, exactly, in the text that the provider saw; it gets the span of one
occurrence in the full text. Every rejection is a warning, in a fixed order of tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import occurrences, trimmed, u16_length

RESOLVER, BROADCAST_FIELDS = "exact-occurrence-v1", 10_000


def indexed_path(path: Column) -> Column:
    """Struct (path, indices): `a[2].b[0]` becomes `a[].b[]` with [2, 0]."""
    digits = F.regexp_extract_all(path, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.struct(
        F.regexp_replace(path, r"\[(\d+)\]", "[]").alias("path"), F.transform(digits, lambda x: x.cast("int")).alias("indices")
    )


def matched_paths(proposals: DataFrame, schema: DataFrame, number: int | None = None) -> DataFrame:
    """`proposals` with field_path resolved against `schema` (path, type, enum_values, inference_type): exactly, else without its indices.

    Adds path_indices (null if the path was exact), known, value_type, enum_values, inference_type. The schema is the caller's field list, broadcast up to
    BROADCAST_FIELDS so that proposals aren't shuffled by their few paths; beyond it, Spark chooses the join. Without `number`, the list is counted.
    """
    fields = schema.select(
        F.col("path").alias("f_path"), F.col("type").alias("value_type"), "enum_values", "inference_type"
    )
    bare = proposals.withColumn("field_path", trimmed(F.coalesce("field_path", F.lit("")))).withColumn("__i", indexed_path(F.col("field_path")))
    exact = fields.select(F.col("f_path").alias("e_path"), F.struct("value_type", "enum_values", "inference_type").alias("e"))
    loose = fields.select(F.col("f_path").alias("l_path"), F.struct("value_type", "enum_values", "inference_type").alias("l"))
    if (schema.count() if number is None else number) <= BROADCAST_FIELDS:
        exact, loose = F.broadcast(exact), F.broadcast(loose)
    joined = bare.join(exact, F.col("field_path") == F.col("e_path"), "left").join(loose, F.col("__i.path") == F.col("l_path"), "left")
    use_loose = F.col("e_path").isNull() & F.col("l_path").isNotNull() & (F.size("__i.indices") > 0)
    found = F.when(F.col("e_path").isNotNull(), F.col("e")).when(use_loose, F.col("l"))
    return (
        joined.withColumn("known", F.col("e_path").isNotNull() | use_loose)
        .withColumn("path_indices", F.when(use_loose, F.col("__i.indices")))
        .withColumn("field_path", F.when(use_loose, F.col("__i.path")).otherwise(F.col("field_path")))
        .withColumns({k: found[k] for k in ("value_type", "enum_values", "inference_type")})
        .drop("__i", "e_path", "l_path", "e", "l")
    )


def spans_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(run_id, excerpt, all_spans) of the distinct (run_id, excerpt) in `wanted`: a text is searched once for each of its excerpts."""
    once = wanted.select("run_id", "excerpt").distinct()
    return once.join(texts.select("run_id", "full_text"), "run_id").select("run_id", "excerpt", occurrences(F.col("full_text"), F.col("excerpt")).alias("all_spans"))


def normalized(proposals: DataFrame, texts: DataFrame, schema: DataFrame, fields: int | None = None) -> DataFrame:
    """Each proposal with `drop_reason` (null if kept), `warning`, the grounded span and clamped confidence.

    `proposals`: run_id, seq (order over all chunks), field_path, value_canon, confidence, excerpt, extractor, occurrence_hint, visible_start and visible_end (UTF-16, of
    what the provider saw; null: of all), maybe is_object (false: the item was none). `texts` (run_id, full_text), a row a run. A proposal with a confidence that isn't a number
    is dropped last, after it has taken its occurrence. `fields`: the number of rows of `schema` if the caller knows it.

    Occurrences are taken in the order of seq by proposals of the same run, path, indices, value and excerpt. Matching is against the
    occurrences that lie whole in the visible text; across overlapping windows the same occurrence keeps its index.
    """
    if "is_object" not in proposals.columns:
        proposals = proposals.withColumn("is_object", F.lit(True))
    p = matched_paths(proposals, schema, fields).withColumns(
        {"extractor": trimmed(F.coalesce("extractor", F.lit(""))), "excerpt": trimmed(F.coalesce("excerpt", F.lit("")))}
    )
    first = (
        F.when(~F.col("is_object"), "not-an-object")
        .when(F.col("field_path") == "", "missing-field-path")
        .when(~F.col("known"), "unknown-field-path")
        .when(F.col("extractor") == "", "missing-extractor")
        .when(F.col("excerpt") == "", "missing-excerpt")
    )
    p = p.withColumn("drop_reason", first)
    none = F.array().cast("array<struct<index:int,start:bigint,end:bigint>>")
    found = spans_of(p.where("drop_reason is null"), texts)
    p = p.join(found, ["run_id", "excerpt"], "left").withColumn("all_spans", F.coalesce("all_spans", none))
    seen = F.filter(
        "all_spans", lambda o: (o["start"] >= F.coalesce("visible_start", F.lit(0))) & (o["end"] <= F.coalesce("visible_end", F.lit(2**62)))
    )
    # a proposal takes on only the spans that it may have: with all of a long text's, its proposals would grow with the square of its length
    p = p.withColumns({"visible_spans": seen, "__count": F.size("all_spans")}).drop("all_spans").withColumn(
        "drop_reason", F.coalesce("drop_reason", F.when(F.size("visible_spans") == 0, "excerpt-not-found"))
    )
    key = ["run_id", "field_path", "path_indices", "value_canon", "excerpt"]
    # occurrences taken so far, in order; the state is a fold, so an identity's kept proposals meet in one row and leave it again
    together = p.where("drop_reason is null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*p.columns).alias("row")))).alias("x"))
    folded = (
        together.withColumn(
            "picks",
            F.aggregate("x", none, lambda done, r: F.concat(done, F.array(_pick(done, r["row"])))),
        )
        .select(F.explode(F.arrays_zip("x", "picks")).alias("z"))
        .select("z.x.row.*", F.col("z.picks").alias("pick"))
    )
    j = folded.unionByName(p.where("drop_reason is not null").withColumn("pick", F.lit(None).cast("struct<index:int,start:bigint,end:bigint>")))
    span = F.col("pick")
    bad = F.col("confidence").isNull() | F.isnan("confidence") | (F.abs("confidence") == float("inf"))
    hinted = (F.col("occurrence_hint") >= 1) & (F.col("occurrence_hint") <= F.size("visible_spans"))
    kept = F.col("drop_reason").isNull()
    out = j.withColumn("drop_reason", F.when(kept & bad, "non-numeric-confidence").otherwise(F.col("drop_reason")))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))
    label = F.concat(F.lit('"'), F.col("field_path"), F.lit('"'))
    warning = (
        F.when(F.col("drop_reason") == "not-an-object", "dropped a proposal that was not an object")
        .when(F.col("drop_reason") == "missing-field-path", "dropped a proposal with a missing fieldPath")
        .when(F.col("drop_reason") == "unknown-field-path", F.concat(F.lit("dropped proposal for unknown fieldPath "), label, F.lit(" (not in targetSchema)")))
        .when(F.col("drop_reason") == "missing-extractor", F.concat(F.lit("dropped proposal for "), label, F.lit(": missing extractor identity")))
        .when(F.col("drop_reason") == "missing-excerpt", F.concat(F.lit("dropped proposal for "), label, F.lit(": missing provenance excerpt")))
        .when(F.col("drop_reason") == "excerpt-not-found", F.concat(F.lit("dropped proposal for "), label, F.lit(": excerpt not found in prepared content")))
        .when(F.col("drop_reason") == "non-numeric-confidence", F.concat(F.lit("dropped proposal for "), label, F.lit(": non-numeric confidence")))
        .when(clamped != F.col("confidence"), F.concat(F.lit("clamped out-of-range confidence for "), label, F.lit(" to "), clamped.cast("int").cast("string")))
    )
    here = F.col("drop_reason").isNull()
    return (
        out.withColumn("warning", warning)
        .withColumn("start", F.when(here, span["start"]))
        .withColumn("end", F.when(here, span["end"]))
        .withColumn("locator", F.when(here, F.concat(F.lit("chars:"), span["start"].cast("string"), F.lit("-"), span["end"].cast("string"))))
        .withColumn(
            "occurrence",
            F.when(
                here,
                F.struct(
                    F.lit(RESOLVER).alias("resolver_version"), F.col("__count").alias("count"), span.alias("selected"),
                    F.when(hinted, "occurrence-hint").otherwise("source-order").alias("selection"),
                    F.coalesce(hinted, F.lit(False)).alias("hint_used"), (F.col("__count") > 1).alias("ambiguous"),
                ),
            ),
        )
        .withColumn("confidence", F.when(here, clamped))
        .drop("__count", "visible_spans", "pick", "known", "is_object")
    )


def _pick(done: Column, r: Column) -> Column:
    """The occurrence (index among all, start, end) that the next proposal of an identity gets."""
    visible, hint = r["visible_spans"], r["occurrence_hint"]
    free = F.filter(visible, lambda o: ~F.array_contains(done, o))
    return (
        F.when((hint >= 1) & (hint <= F.size(visible)), F.get(visible, hint - 1))
        .otherwise(F.coalesce(F.get(free, F.lit(0)), F.get(visible, F.size(visible) - 1)))
    )


def deduplicated(kept: DataFrame) -> DataFrame:
    """One proposal of those of the same run, path, indices, value and span: the most confident, the earliest of equals, at the first one's place.

    Adds `position` (the place) and `duplicates` (how many were folded in).
    """
    key = ["run_id", "field_path", "path_indices", "value_canon", "locator"]
    rank = W.partitionBy(*key).orderBy(F.desc("confidence"), "seq")
    whole = W.partitionBy(*key)
    return (
        kept.withColumn("__k", F.row_number().over(rank))
        .withColumn("position", F.min("seq").over(whole))
        .withColumn("duplicates", F.count(F.lit(1)).over(whole) - 1)
        .where("__k = 1")
        .drop("__k")
    )
