"""Content-addressed identity of prepared texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import u16_length

FORMAT, VERSION, PREPARATION_VERSION = "prepared-artifact", 1, "1"
MODES = tuple("image-ocr markdown pdf-text text transcript".split())


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def binding(digest: Column, mode: Column, version: Column, length: Column, snapshot_ref: Column, format: str = FORMAT) -> Column:
    """The JSON, in fixed order, whose hash is the identity; no snapshot is null in it."""
    return F.concat(
        F.lit(f'{{"format":"{format}","version":{VERSION},"digest":'), _quoted(digest), F.lit(',"preparationMode":'), _quoted(mode),
        F.lit(',"preparationVersion":'), _quoted(version), F.lit(',"contentLength":'), length.cast("string"), F.lit(',"sourceSnapshotRef":'),
        F.when(snapshot_ref.isNull(), "null").otherwise(_quoted(snapshot_ref)), F.lit("}"),
    )


def artifact(text: Column, mode: Column, snapshot_ref: Column, version: str = PREPARATION_VERSION, format: str = FORMAT) -> Column:
    """Struct (format, version, digest, ref, preparation_mode, preparation_version, content_length, source_snapshot_ref)."""
    digest, length = F.sha2(text, 256), u16_length(text)
    identity = F.sha2(binding(digest, mode, F.lit(version), length, snapshot_ref, format), 256)
    return F.struct(
        F.lit(format).alias("format"), F.lit(VERSION).alias("version"), digest.alias("digest"),
        F.concat(F.lit(f"{format}:v{VERSION}:sha256:"), identity).alias("ref"), mode.alias("preparation_mode"), F.lit(version).alias("preparation_version"),
        length.alias("content_length"), snapshot_ref.alias("source_snapshot_ref"),
    )


def parsed_ref(ref: Column, format: str = FORMAT) -> Column:
    """The hash of a well-formed reference, else null."""
    return F.nullif(F.regexp_extract(ref, rf"^{format}:v{VERSION}:sha256:([0-9a-f]{{64}})$", 1), F.lit(""))


def validated(a: Column, format: str = FORMAT) -> Column:
    """Struct (status: valid, invalid or identity-mismatch; reason), the first test that fails."""
    again = F.concat(
        F.lit(f"{format}:v{VERSION}:sha256:"),
        F.sha2(binding(a["digest"], a["preparation_mode"], a["preparation_version"], a["content_length"], a["source_snapshot_ref"], format), 256),
    )
    reason = (
        F.when(a.isNull(), "not-an-object")
        .when(~F.coalesce(a["format"] == format, F.lit(False)), "format")
        .when(~F.coalesce(a["version"] == VERSION, F.lit(False)), "version")
        .when(~F.coalesce(a["digest"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
        .when(parsed_ref(a["ref"], format).isNull(), "ref")
        .when(~F.coalesce(a["preparation_mode"].isin(*MODES), F.lit(False)), "preparation-mode")
        .when(~F.coalesce(a["preparation_version"] != "", F.lit(False)), "preparation-version")
        .when(~F.coalesce(a["content_length"] >= 0, F.lit(False)), "content-length")
        .when(a["source_snapshot_ref"] == "", "source-snapshot-ref")
    )
    status = F.when(reason.isNotNull(), "invalid").when(again != a["ref"], "identity-mismatch").otherwise("valid")
    return F.struct(status.alias("status"), reason.alias("reason"))


def resolved(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """`requests` (..., artifact) with `state` and `text` from the store `texts` (ref, text): valid ones are looked up and hashed again."""
    v = validated(F.col("artifact"))
    rows = requests.withColumn("__v", v).join(
        texts.select(F.col("ref").alias("__ref"), F.col("text").alias("__text")), F.col("artifact.ref") == F.col("__ref"), "left"
    )
    state = (
        F.when(F.col("__v.status") != "valid", F.col("__v.status"))
        .when(F.col("__ref").isNull(), "unavailable")
        .when(F.col("__text").isNull(), "invalid-resolved-text")
        .when((F.sha2("__text", 256) != F.col("artifact.digest")) | (u16_length(F.col("__text")) != F.col("artifact.content_length")), "digest-mismatch")
        .otherwise("available")
    )
    return rows.withColumn("state", state).withColumn("text", F.when(state == "available", F.col("__text"))).drop("__v", "__ref", "__text")
