"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids of `edges` (u BIGINT, v BIGINT); root is the least id that it is connected with.

    Nulls and loops are ignored (an id that has only a loop has no row), repeated edges count once. Every round is checkpointed; it ends with the
    first that changes nothing, after a number of rounds about the logarithm of the longest path.
    """
    a, b = F.col("u"), F.col("v")
    e = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e)
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each neighbour above u joins the least of u and its neighbours
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its neighbours below join the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        e = cut(small)
        now = _mark(e)
        if now == before:
            break
        before = now
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
