"""Chunks: overlapping windows of a text, or ordered pieces put together with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import u16_length, u16_slice

SIZE, OVERLAP, MOST = 12_000, 200, 40


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (start, end), UTF-16: steps of size - overlap, the last window is the one that reaches the end; none of an empty text."""
    step, length = max(1, size - overlap), u16_length(text)
    last = F.ceil(F.greatest(length - size, F.lit(0)) / step)
    spans = F.transform(
        F.sequence(F.lit(0).cast("bigint"), last),
        lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, length).alias("end")),
    )
    return F.when(length > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def window_count(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """How many windows a text has, without making them."""
    length = u16_length(text)
    return F.when(length > 0, F.ceil(F.greatest(length - size, F.lit(0)) / max(1, size - overlap)) + 1).otherwise(0).cast("int")


def window_chunks(
    docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, most: int | None = MOST, blank: bool = False
) -> DataFrame:
    """One row per window: the columns of `docs` but the text, chunk_idx, start, end, chunk, n_chunks, truncated_chunks.

    Windows beyond `most` are left out and counted in truncated_chunks. A row without text has no windows, an empty text one empty window if `blank`, else none.
    """
    spans = windows(F.col(text), size, overlap)
    if blank:
        zero = F.lit(0).cast("bigint")
        spans = F.when(F.col(text) == "", F.array(F.struct(zero.alias("start"), zero.alias("end")))).otherwise(spans)
    kept = spans if most is None else F.slice(spans, 1, most)
    keep = [c for c in docs.columns if c != text]
    return (
        docs.withColumn("__n", F.size(spans))
        .select(*keep, text, "__n", F.posexplode(kept).alias("chunk_idx", "w"))
        .select(
            *keep,
            "chunk_idx",
            F.col("w.start").alias("start"),
            F.col("w.end").alias("end"),
            u16_slice(F.col(text), F.col("w.start").cast("int"), F.col("w.end").cast("int")).alias("chunk"),
            F.col("__n").alias("n_chunks"),
            F.greatest(F.col("__n") - most, F.lit(0)).alias("truncated_chunks") if most is not None else F.lit(0).alias("truncated_chunks"),
        )
    )


def assembled(pieces: Column, most: int = MOST) -> Column:
    """Of an array of texts, struct (full_text, chunks (text, start, end), truncated): empty ones dropped, at most `most`, joined by a blank line that belongs to none."""
    real = F.filter(pieces, lambda x: x != "")
    kept = F.slice(real, 1, most)
    chunks = F.aggregate(
        kept,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<text:string,start:bigint,end:bigint>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + u16_length(x) + 2).alias("at"),
            F.concat(s["out"], F.array(F.struct(x.alias("text"), s["at"].alias("start"), (s["at"] + u16_length(x)).alias("end")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.struct(
        F.array_join(kept, "\n\n").alias("full_text"), chunks.alias("chunks"), F.greatest(F.size(real) - most, F.lit(0)).alias("truncated")
    )


def repeated_groups(elements: DataFrame, least: int = 3) -> DataFrame:
    """The largest group of like children in a page: of `elements` (page_id, parent, order, signature, text_length), (page_id, parent, signature, n, size).

    Groups of at least `least`; most members first, then most text, then the first in order.
    """
    from pyspark.sql import Window as W

    groups = elements.groupBy("page_id", "parent", "signature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("text_length").alias("size"), F.min("order").alias("first")
    ).where(F.col("n") >= least)
    best = W.partitionBy("page_id").orderBy(F.desc("n"), F.desc("size"), "first")
    return groups.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "first")
