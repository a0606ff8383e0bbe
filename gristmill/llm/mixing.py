"""Mixing sources to target weights: capped water-filling and seeded repetition.

Each source holds some bytes of text and may be repeated up to `max_epochs` times. A budget of
bytes is shared out by weight; a source whose share exceeds its cap is clamped there and the excess
goes to the others in proportion to their weights, again and again until all shares are feasible.
In closed form: by ascending cap per weight, source i is clamped if its cap is at most its share of
what the sources before it (all clamped) leave. If the caps add up to less than the budget, all are
clamped.

A share of e epochs gives each document floor(e) repetitions, and one more to those whose seeded
hash falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, unit

MAX_EPOCHS, SEED = 4.0, 17
#: Up to so many sources, their epochs are broadcast to the documents; beyond it, Spark chooses the join.
BROADCAST_SOURCES = 100_000


def shares(
    sizes: DataFrame, budget: float | None = None, max_epochs: float = MAX_EPOCHS, weights: dict[str, float] | None = None
) -> DataFrame:
    """(source, size, epochs) for `sizes` (source, size); `budget` is the sum of sizes if None.

    `weights`: by source, 0 for those it doesn't name; None: equal weights. Sources of no weight or no
    text get 0 epochs. Shares are rounded to 9 decimals, so that the order of summing doesn't matter.
    """
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    live = sizes.withColumn("w", F.when(F.col("size") > 0, weight).otherwise(0.0)).withColumn(
        "cap", F.col("size") * F.lit(float(max_epochs))
    )
    everything = W.partitionBy()  # one row a source
    before = everything.orderBy(F.col("ratio"), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("size").over(everything) if budget is None else F.lit(float(budget))
    filled = (
        live.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
        .withColumn("budget", total.cast("double"))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn(
            "left_b",
            F.col("budget") - F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(before), F.lit(0.0)),
        )
        .withColumn("level", F.when(F.col("w") > 0, F.greatest(F.col("left_b"), F.lit(0.0)) / F.col("left_w")))
        # the level of the first source that isn't clamped holds for it and all after it
        .withColumn(
            "open",
            F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"],
        )
        .withColumn("clamped", F.col("open").isNull() | (F.col("ratio") <= F.col("open")))
    )
    share = F.when(F.col("w") <= 0, 0.0).when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * F.col("open"))
    return filled.select(
        "source", "size", F.when(F.col("size") > 0, F.round(share / F.col("size"), 9)).otherwise(0.0).alias("epochs")
    )


def mix_sources(
    docs: DataFrame,
    budget: float | None = None,
    max_epochs: float = MAX_EPOCHS,
    weights: dict[str, float] | None = None,
    seed: int = SEED,
    numbered: bool = False,
) -> DataFrame:
    """The rows of `docs`, each as often as its source's share of the budget asks; same columns.

    A document's size is its text's bytes in UTF-8. A null source is a source of its own. Null and empty
    texts have no size but are repeated like others of their source; where a whole source has no text
    they go. Repeated rows and repeated ids are drawn alike, as the draw hashes doc_id (null: one draw).
    An empty table gives an empty table; other columns go along whatever their names. `numbered`
    adds `copy` (BIGINT, from 0), which replaces a column of that name.
    """
    sizes = docs.groupBy(F.col("source").alias("source")).agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("double").alias("size")
    )
    own, epochs, rounds, k = fresh(docs, "own", "epochs", "rounds", "k")
    plan = cut(shares(sizes, budget, max_epochs, weights).select(F.col("source").alias(own), F.col("epochs").alias(epochs)))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col(own)), "left")
    whole = F.floor(epochs)
    times = (whole + F.when(unit(F.col("doc_id"), seed) < F.col(epochs) - whole, 1).otherwise(0)).cast("int")
    repeated = joined.withColumn(rounds, times).where(F.col(rounds) > 0)
    kept = [F.col(f"`{c}`") for c in docs.columns if not numbered or c.lower() != "copy"]
    each = repeated.withColumn(k, F.explode(F.sequence(F.lit(0), F.col(rounds) - 1)))
    return each.select(*kept, *([F.col(k).cast("bigint").alias("copy")] if numbered else []))


ORACLE = f"""
WITH sizes AS (
  SELECT source, CAST(sum(strlen(text)) AS DOUBLE) AS size FROM documents GROUP BY source
), live AS (
  SELECT source, size, size * {MAX_EPOCHS} AS ratio, sum(size) OVER () AS budget, count(*) OVER () AS n FROM sizes
), levels AS (
  SELECT *, greatest(budget - coalesce(sum(ratio) OVER b, 0), 0) / (n - (row_number() OVER (ORDER BY ratio, source) - 1)) AS level
  FROM live WINDOW b AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, first_value(level) OVER (ORDER BY ratio <= level, ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_level,
    max(ratio > level) OVER () AS unclamped FROM levels
), plan AS (
  SELECT source, round((CASE WHEN NOT unclamped OR ratio <= first_level THEN ratio ELSE first_level END) / size, 9) AS epochs FROM opened
), drawn AS (
  SELECT d.doc_id, d.source, floor(epochs) AS whole, epochs - floor(epochs) AS part,
    CAST(('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN plan p ON d.source = p.source
)
SELECT doc_id, source, unnest(range(CAST(whole AS BIGINT) + CASE WHEN u < part THEN 1 ELSE 0 END)) AS copy FROM drawn
"""
