"""Robots rules: parsing files and deciding requests, as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.urls import product_token


def parsed(files: DataFrame) -> DataFrame:
    """(origin, rule_idx, path, allow) that hold for an agent, of `files` (origin, body, agent).

    Of the groups of a file, the first with the best match holds: the agent's own token, then one that is a prefix of the other, then `*`.
    Groups aren't merged; an empty Disallow is no rule.
    """
    line = F.trim(F.regexp_replace("x", "#.*$", ""))
    lines = (
        files.select("origin", product_token(F.col("agent")).alias("token"), F.posexplode(F.split("body", r"\r?\n", -1)).alias("i", "x"))
        .withColumn("key", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))))
        .withColumn("value", F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)))
        .where(F.col("key").isin("user-agent", "allow", "disallow"))
    )
    file = W.partitionBy("origin", "token").orderBy("i")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(file), F.lit("")) != "user-agent")
    grouped = lines.withColumn("g", F.sum(begins.cast("int")).over(file)).where("g > 0")
    name = F.lower("value")
    score = (
        F.when(name == F.col("token"), 3)
        .when((name != "*") & (name != "") & (F.startswith(F.col("token"), name) | F.startswith(name, F.col("token"))), 2)
        .when(name == "*", 1)
        .otherwise(0)
    )
    scores = grouped.where("key = 'user-agent'").groupBy("origin", "token", "g").agg(F.max(score).alias("score")).where("score > 0")
    best = scores.withColumn("k", F.row_number().over(W.partitionBy("origin", "token").orderBy(F.desc("score"), "g"))).where("k = 1")
    rules = grouped.where("key != 'user-agent' and value != ''").join(best.select("origin", "token", "g"), ["origin", "token", "g"], "left_semi")
    return rules.select(
        "origin", (F.row_number().over(W.partitionBy("origin").orderBy("i")) - 1).alias("rule_idx"), F.col("value").alias("path"), (F.col("key") == "allow").alias("allow")
    )


def decided(requests: DataFrame, rules: DataFrame, key: str = "request_id") -> DataFrame:
    """`requests` (key, origin, path, ...) with `allowed`: by the longest rule path that the request's begins with, Allow before Disallow; no rule allows."""
    hits = requests.select(key, "origin", F.col("path").alias("r_path")).join(
        rules.select("origin", F.col("path").alias("rule"), "allow"), "origin"
    ).where(F.startswith("r_path", "rule"))
    verdict = hits.groupBy(key).agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allowed"))
    return requests.join(verdict, key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def loaded(status):
    """What a robots response means: struct (rules: parse, allow-all; warning)."""
    ok = status.between(200, 299)
    open_ = status.isNull() | (status == 429) | (status >= 500)
    return F.struct(
        F.when(ok, "parse").otherwise("allow-all").alias("rules"),
        F.when(status.isNull(), "robots.txt unreachable; failing open").when(open_, F.concat(F.lit("robots.txt returned "), status.cast("string"), F.lit("; failing open"))).alias("warning"),
    )
