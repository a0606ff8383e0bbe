"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines of a text is a window, hashed to 128 bits. Over the whole table
the first occurrence of a window, by doc_id and line, stays; the lines of every later one are covered.
Covered positions are merged to ranges, and each text is put together from the slices between them.

The hashes are made once and written to the shared folder. The first occurrences are found by an
aggregation with partial results on the map side, so that a window repeated in millions of documents
doesn't meet in one task, and come back to the windows by a join that Spark can split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, written

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, pos, h1, h2): all windows with a character that isn't white space; t tells apart texts of one id."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), _lines(F.col("text")).alias("l")).where(
        F.size("l") >= window
    )

    def one(i):
        parts = [F.get("l", i + k) for k in range(window)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*parts).alias("h1"),
            F.xxhash64(F.lit("second"), *parts).alias("h2"),
            F.concat(*parts).rlike(r"[^\s]").alias("full"),
        )

    at = F.sequence(F.lit(0), F.size("l") - window)
    return (
        lines.select("doc_id", "t", F.explode(F.transform(at, one)).alias("w"))
        .where("w.full")
        .select("doc_id", "t", "w.pos", "w.h1", "w.h2")
    )


def covered_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, kept, done, removed) of texts with covered lines: the slices [from, to) before the last covered range, its end, how many lines are covered."""
    windows = written(line_windows(docs, window))
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    later = windows.join(first, ["h1", "h2"]).where(
        ~F.struct("doc_id", "t", "pos").eqNullSafe(F.col("first"))
    )
    doc = W.partitionBy("doc_id", "t")
    order = doc.orderBy("pos")
    ranges = (
        later.select("doc_id", "t", "pos")
        .distinct()
        .withColumn("new", (F.col("pos") - F.lag("pos").over(order) > window) | F.lag("pos").over(order).isNull())
        .withColumn("island", F.sum(F.col("new").cast("int")).over(order))
        .groupBy("doc_id", "t", "island")
        .agg(F.min("pos").alias("a"), (F.max("pos") + window).alias("b"))
    )
    before = F.lag("b", 1, 0).over(doc.orderBy("a"))
    return (
        ranges.withColumn("seg", F.struct(before.alias("from"), F.col("a").alias("to")))
        .groupBy("doc_id", "t")
        .agg(
            F.array_sort(F.collect_list("seg")).alias("kept"),
            F.max("b").alias("done"),
            F.sum(F.col("b") - F.col("a")).cast("int").alias("removed"),
        )
    )


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the lines of repeated windows, and `lines_removed` (INT), which replaces a column of that name.

    Later occurrences inside one text count too. Texts of fewer than three lines, null texts (they stay
    null) and empty ones stay as they are; windows of only white space are never covered. A text whose
    lines are all covered becomes empty; no row goes. Equal rows (same doc_id and text) are one document
    and get the same result; a null doc_id comes before all others. The order of rows doesn't matter. doc_id is of any type that can be
    ordered; other columns go along, whatever their names. An empty table gives an empty table.
    """
    own, t, kept, done, removed = fresh(docs, "id", "t", "kept", "done", "removed")
    ranges = covered_ranges(docs, window).toDF(own, t, kept, done, removed)
    names = [c for c in docs.columns if c.lower() != "lines_removed"]
    joined = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(t)), "left")
    lines = _lines(F.col("text"))
    slices = F.flatten(F.transform(kept, lambda s: F.slice(lines, s["from"] + 1, s["to"] - s["from"])))
    tail = F.slice(lines, F.col(done) + 1, F.size(lines))
    text = F.when(F.col(done).isNull(), F.col("text")).otherwise(F.array_join(F.concat(slices, tail), "\n"))
    return joined.select(
        *(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names),
        F.coalesce(removed, F.lit(0)).alias("lines_removed"),
    )


ORACLE = r"""
WITH lined AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, i AS pos, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS i FROM lined WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, pos FROM windows WHERE regexp_matches(w, '[^\s]')
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS line FROM later
), kept AS (
  SELECT d.doc_id, count(c.line) AS gone, string_agg(CASE WHEN c.line IS NULL THEN x END, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM lined) d
  LEFT JOIN covered c ON d.doc_id = c.doc_id AND d.i = c.line GROUP BY d.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, CAST(gone AS INTEGER) AS lines_removed FROM kept
"""
