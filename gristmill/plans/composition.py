"""From sources to results: fetch or replay, capture, extract; and the same for the pages of a crawl."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.sources import fetching, snapshots

from .extraction import Extraction, extract, from_snapshots
from .tables import Written

LIVE, CAPTURE, REPLAY = "live", "live-with-capture", "replay"


@dataclass
class Composition:
    """`fetched`: (source_id, snapshot_ref, error, warnings, ...) of each source; `extraction`: the tables of those that gave a snapshot, with source_id as run_id."""

    fetched: DataFrame
    extraction: Extraction
    written: Written

    def release(self) -> None:
        self.extraction.release()
        self.written.release()


def _with_refs(shots: DataFrame) -> DataFrame:
    return snapshots.with_refs(shots.withColumn("run_id", F.col("source_id")))


def fetch_and_extract(
    sources: DataFrame, schema: DataFrame, provider, options=None, *, mode: str = LIVE, client: Callable | None = None, renderer: Callable | None = None, clock=None, store: str | None = None, **how
) -> Composition:
    """`sources` (source_id, url, ...), each fetched or replayed once, and extracted from. `store`: a folder of snapshots.

    live fetches (validators from the store, if there is one), live-with-capture also appends what was fetched to the store before it is read, replay takes the latest of the store and fetches nothing. A source without a snapshot has
    its error in `fetched` and no result. The reference of the snapshot is the source of the result and part of its artifact. `how` goes to `extract`; its `store` is `text_store` here.
    """
    spark, written = sources.sparkSession, Written(sources.sparkSession)
    if mode not in (LIVE, CAPTURE, REPLAY):
        raise ValueError(f"unknown mode {mode}")
    if mode == REPLAY and store is None:
        raise ValueError("mode 'replay' requires a store")
    if mode == REPLAY:
        got = snapshots.replayed(sources.select("source_id"), snapshots.load(spark, store).drop("error")).withColumn("kind", F.col("error"))
        shots = got.where("error is null").select("source_id", *[c for c in fetching._FIELDS if c != "source_id"])
        told = got.select("source_id", F.when(F.col("kind").isNotNull(), F.struct(F.col("kind"), F.lit("the store has no snapshot of the source").alias("message"), F.lit(None).cast("int").alias("status"))).alias("error"), F.array().cast("array<string>").alias("warnings"))
    else:
        if client is None:
            raise ValueError("live modes need a client")
        known = None
        if store is not None and snapshots.exists(spark, store):
            known = snapshots.load(spark, store)
        got = written(fetching.fetched(sources, client, renderer, clock, known))
        shots = got.where("snapshot is not null").select("snapshot.*")
        if mode == CAPTURE and store is not None:
            snapshots.put(shots, store)
        told = got.select("source_id", "error", "warnings", "escalation")
    shots = written(_with_refs(shots))
    fetched = told.join(shots.select("source_id", "snapshot_ref"), "source_id", "left")
    if "text_store" in how:
        how["store"] = how.pop("text_store")
    return Composition(fetched, extract(from_snapshots(shots), schema, provider, options, **how), written)


def crawl_and_extract(manifest: dict, spark, schema: DataFrame, provider, options=None, **how) -> Composition:
    """The pages of a crawl's manifest (`sources.crawling.crawl`) extracted from, each with the whole budget; run_id is a page's place in the manifest, so that results sort in its order."""
    written = Written(spark)
    fields = f"run_id bigint, source_id string, depth int, snapshot {fetching._SNAPSHOT}, error struct<kind:string,message:string,status:int>, warnings array<string>"
    rows = []
    for k, page in enumerate(manifest["pages"]):
        shot = page["result"]["snapshot"]
        rows.append((k, shot["source_id"] if shot else None, page["depth"], {c: shot.get(c) for c in fetching._FIELDS} if shot else None, page["result"]["error"], page["result"]["warnings"]))
    got = spark.createDataFrame(rows, fields)  # at most MOST_PAGES
    shots = written(snapshots.with_refs(got.where("snapshot is not null").select("run_id", "snapshot.*")))
    fetched = got.select("run_id", "depth", "error", "warnings").join(shots.select("run_id", "url", "snapshot_ref"), "run_id", "left")
    if "text_store" in how:
        how["store"] = how.pop("text_store")
    return Composition(fetched, extract(from_snapshots(shots), schema, provider, options, **how), written)
