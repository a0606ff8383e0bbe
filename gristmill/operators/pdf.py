"""PDF sidecars: page offsets, layout, and which of it a span touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import let, u16_length

DROPPED_OFFSETS = "dropped pdfPageOffsets: malformed or out-of-range page offsets"
DROPPED_LAYOUT = "dropped pdfLayout: malformed or out-of-range layout mapping"
DROPPED_WARNINGS = "dropped extractor-reported warnings: not an array of strings"
LAYOUT = (
    "struct<pages:array<struct<page_number:int,width:double,height:double>>,elements:array<struct<kind:string,page_number:int,start:bigint,end:bigint,bounds:struct<x:double,y:double,width:double,height:double>>>,"
    "tables:array<struct<page_number:int,cells:array<struct<row_index:int,column_index:int,start:bigint,end:bigint,bounds:struct<x:double,y:double,width:double,height:double>>>>>>"
)


def valid_offsets(offsets: Column, text: Column) -> Column:
    """The page offsets if all are in the text and none decreases, else null."""
    ok = F.forall(offsets, lambda x: x.isNotNull() & (x >= 0) & (x <= u16_length(text))) & (offsets == F.array_sort(offsets))
    return F.when(ok, offsets)


def page_of(offsets: Column, offset: Column) -> Column:
    """The last page, from 1, that starts at or before the offset; null before the first, or without pages."""
    return F.when(offset >= 0, F.nullif(F.size(F.filter(offsets, lambda x: x <= offset)), F.lit(0)))


def parsed_locator(locator: Column) -> Column:
    """Struct (start, end, reason) of `chars:S-E`; the reason is unsupported-scheme or malformed-range if it isn't one."""
    shape = r"^chars:(0|[1-9]\d*)-(0|[1-9]\d*)$"
    start, end = (F.regexp_extract(locator, shape, k).try_cast("bigint") for k in (1, 2))
    reason = F.when(~F.startswith(locator, F.lit("chars:")), "unsupported-scheme").when(
        start.isNull() | end.isNull() | (end <= start) | (end > 9007199254740991), "malformed-range"
    )
    return F.struct(F.when(reason.isNull(), start).alias("start"), F.when(reason.isNull(), end).alias("end"), reason.alias("reason"))


def in_page(b: Column, page: Column) -> Column:
    """Whether a box lies in its page; pages of unknown size hold all."""
    return (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0) & F.coalesce(
        (b["x"] + b["width"] <= page["width"]) & (b["y"] + b["height"] <= page["height"]), F.lit(True)
    )


def valid_layout(layout: Column, text: Column) -> Column:
    """The layout in canonical order, or null if any member is bad.

    `layout`: struct (pages (page_number, width, height), elements (kind, page_number, start, end, bounds), tables (page_number, cells
    (row_index, column_index, start, end, bounds))). Ranges are whole, not empty, in the text; page numbers and (row, column) are unique.
    """
    length = u16_length(text)

    def checked(v: Column) -> Column:
        pages = F.coalesce(v["pages"], F.array().cast("array<struct<page_number:int,width:double,height:double>>"))
        page = lambda n: F.get(F.filter(pages, lambda p: p["page_number"] == n), F.lit(0))
        ranged = lambda x: F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= length), F.lit(False))
        boxed = lambda x, n: x["bounds"].isNull() | F.coalesce(in_page(x["bounds"], page(n)), F.lit(False))
        numbers = F.transform(pages, lambda p: p["page_number"])
        ok = (
            (F.size(numbers) == F.size(F.array_distinct(numbers)))
            & F.forall(pages, lambda p: (p["page_number"] >= 1) & F.coalesce((p["width"] > 0) & (p["height"] > 0), F.lit(True)))
            & F.forall(v["elements"], lambda e: ranged(e) & (e["page_number"] >= 1) & boxed(e, e["page_number"]))
            & F.forall(
                v["tables"],
                lambda t: F.forall(t["cells"], lambda c: ranged(c) & (c["row_index"] >= 0) & (c["column_index"] >= 0) & boxed(c, t["page_number"]))
                & (
                    F.size(F.array_distinct(F.transform(t["cells"], lambda c: F.struct(c["row_index"], c["column_index"])))) == F.size(t["cells"])
                ),
            )
        )
        order = lambda xs, *keys: F.transform(
            F.array_sort(F.transform(xs, lambda x: F.struct(*[x[k].alias(k) for k in keys], x.alias("x")))), lambda s: s["x"]
        )
        tables = F.transform(
            v["tables"],
            lambda t: F.struct(t["page_number"].alias("page_number"), order(t["cells"], "row_index", "column_index", "start").alias("cells")),
        )
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(pages.alias("pages"), order(v["elements"], "start", "end", "page_number", "kind").alias("elements"), tables.alias("tables")))

    return let(layout, checked)


def overlapping(spans: DataFrame, elements: DataFrame, bucket: int = 4096) -> DataFrame:
    """Half-open overlaps of `spans` (doc_id, span_id, start, end) with `elements` (doc_id, element_id, start, end): (doc_id, span_id, element_id).

    An equi-join on document and bucket of the text, so it shuffles by both and never compares all with all; an overlap is taken in the bucket where it begins.
    """
    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))

    a = bucketed(spans.where(F.col("end") > F.col("start"))).select("doc_id", "b", "span_id", F.col("start").alias("s"), F.col("end").alias("e"))
    b = bucketed(elements.where(F.col("end") > F.col("start"))).select("doc_id", "b", "element_id", "start", "end")
    hit = (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")) & (F.floor(F.greatest("s", "start") / bucket) == F.col("b"))
    return a.join(b, ["doc_id", "b"]).where(hit).select("doc_id", "span_id", "element_id")


def resolved_spans(spans: DataFrame, elements: DataFrame) -> DataFrame:
    """`spans` (doc_id, span_id, locator) with `status` (matched, not-found, invalid-locator), `reason` and the `elements` touched."""
    parsed = spans.withColumn("p", parsed_locator(F.col("locator")))
    good = parsed.where("p.reason is null").select("doc_id", "span_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    hits = overlapping(good, elements).groupBy("doc_id", "span_id").agg(F.array_sort(F.collect_list("element_id")).alias("elements"))
    status = F.when(F.col("p.reason").isNotNull(), "invalid-locator").when(F.col("elements").isNotNull(), "matched").otherwise("not-found")
    return parsed.join(hits, ["doc_id", "span_id"], "left").select("doc_id", "span_id", "locator", status.alias("status"), F.col("p.reason").alias("reason"), "elements")
