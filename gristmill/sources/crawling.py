"""Bounded breadth-first crawls within an origin: live, level by level, or over a table of links."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, urldefrag, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.markup import same_host_links

from gristmill.plans.tables import shared_folder

from .fetching import Session, fetch_one

PAGES, MOST_PAGES, DEPTH, MOST_DEPTH = 20, 500, 2, 10
INHERITED = ("min_delay_ms", "timeout_ms", "retries", "headers", "user_agent", "respect_robots", "revalidate", "render")


def page_id(seed_id: str, url: str) -> str:
    return f"{quote(seed_id, safe='!~*()' + chr(39))}::{url}"


def crawl(session: Session, seed: dict, max_pages: int = PAGES, max_depth: int = DEPTH, fetch: Callable = fetch_one, keep: Callable | None = None) -> dict:
    """(pages in breadth-first order with depth, truncated, warnings): one fetch a page, links of the seed's origin only.

    A page that redirects to another origin stays, but its links aren't followed. `keep` is called with each snapshot; its failure is a warning.
    """
    max_pages, max_depth = max(1, min(max_pages, MOST_PAGES)), max(0, min(max_depth, MOST_DEPTH))
    start = urldefrag(seed["url"])[0]
    where = urlsplit(start)[:2]
    queue, seen, pages, warnings = [(start, 0)], {start}, [], []
    while queue and len(pages) < max_pages:
        url, depth = queue.pop(0)
        source = {k: seed[k] for k in INHERITED if k in seed} | {"source_id": page_id(seed["source_id"], url) if pages else seed["source_id"], "url": url}
        got = fetch(session, source)
        shot = got["snapshot"]
        if shot and keep:
            try:
                keep(shot)
            except Exception as e:
                warnings.append(f"[depth {depth}] {url}: store.put failed ({e}); page fetch result kept, snapshot not persisted")
        warnings += [f"[depth {depth}] {url}: {w}" for w in got["warnings"]]
        pages.append({"url": url, "depth": depth, "result": got})
        if not shot or depth >= max_depth or shot["content_type"] != "html":
            continue
        if urlsplit(shot["url"])[:2] != where:
            warnings.append(f"[depth {depth}] {url}: fetched page resolved off-host ({shot['url']}); its links were not followed")
            continue
        for link in same_host_links(shot["body"] or "", shot["url"]):
            if link not in seen:
                seen.add(link)
                queue.append((link, depth + 1))
    if queue:
        warnings.append(f"maxPages cap ({max_pages}) reached; {len(queue)} further URL(s) discovered but not fetched")
    return {"pages": pages, "truncated": bool(queue), "warnings": warnings}


def breadth_first(seeds: DataFrame, edges: DataFrame, max_pages: int = PAGES, max_depth: int = DEPTH) -> DataFrame:
    """(seed_id, seq, depth, url) of crawls over `edges` (page, pos, link) from `seeds` (seed_id, url).

    One join a level: a new page belongs to the first link that reaches it, by the place of the linking page, then of the link; a level that passes max_pages is cut before the next is
    looked up. Each level is checkpointed, as the next depends on all before.
    """
    max_pages, max_depth = max(1, min(max_pages, MOST_PAGES)), max(0, min(max_depth, MOST_DEPTH))
    shared_folder(seeds.sparkSession)
    done = seeds.select("seed_id", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("depth"), "url").checkpoint()
    level = done
    for depth in range(1, max_depth + 1):
        found = level.join(edges, level["url"] == edges["page"]).select("seed_id", F.col("link").alias("url"), F.struct("seq", "pos").alias("at"))
        first = found.groupBy("seed_id", "url").agg(F.min("at").alias("at")).join(done.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
        known = done.groupBy("seed_id").agg((F.max("seq") + 1).alias("n"))
        place = F.row_number().over(W.partitionBy("seed_id").orderBy("at")) - 1
        level = (
            first.join(known, "seed_id").withColumn("seq", F.col("n") + place).where(F.col("seq") < max_pages)
            .select("seed_id", F.col("seq").cast("bigint").alias("seq"), F.lit(depth).alias("depth"), "url").checkpoint()
        )
        if level.isEmpty():
            break
        done = done.unionByName(level).checkpoint()
    return done
