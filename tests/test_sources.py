"""Fetching, robots, snapshots, crawls, captions, references, streams: no network."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import urls as U
from gristmill.sources import captions, crawling, fetching, robots, snapshots
from gristmill.streaming import flows


class Site:
    """Scripted responses by URL; each list is used up to its last."""

    def __init__(self, pages):
        self.pages, self.asked = {k: list(v) if isinstance(v, list) else [v] for k, v in pages.items()}, []

    def __call__(self, url, headers, timeout_ms):
        self.asked.append((url, headers))
        if url not in self.pages:
            return {"status": 404, "headers": {}, "body": ""}
        rows = self.pages[url]
        r = rows.pop(0) if len(rows) > 1 else rows[0]
        if isinstance(r, Exception):
            raise r
        return {"status": 200, "headers": {"Content-Type": "text/html"}, "body": ""} | r


class Still:
    def __init__(self):
        self.t, self.slept = 0.0, []

    def clock(self):
        return fetching.Clock(now=lambda: self.t, sleep=self.sleep, draw=lambda: 0.5, stamp=lambda: "2026-01-01T00:00:00.000Z")

    def sleep(self, ms):
        self.slept.append(ms)
        self.t += ms


def fetch(pages, source=None, **kw):
    site, still = Site(pages), Still()
    s = fetching.Session(site, still.clock(), kw.pop("renderer", None))
    return fetching.fetch_one(s, {"source_id": "s", "url": "https://h.example/a"} | (source or {}), **kw), site, still


def test_fetch_retries_and_errors():
    got, site, still = fetch({"https://h.example/a": [{"status": 500}, TimeoutError(), {"body": "x"}]})
    assert got["snapshot"]["body"] == "x" and len(got["warnings"]) == 2 and still.slept[:2] == [250, 500]
    got, site, _ = fetch({"https://h.example/a": {"status": 404}})
    assert got["error"]["kind"] == "http-error" and got["error"]["status"] == 404 and len(site.asked) == 2
    got, site, _ = fetch({"https://h.example/a": {"status": 503}}, {"retries": 99})
    assert len(site.asked) == 1 + 6 and got["error"]["status"] == 503
    assert fetch({}, {"url": "ftp://x"})[0]["error"]["kind"] == "invalid-config"
    assert fetch({}, {"render_policy": "odd"})[0]["error"]["kind"] == "invalid-config"


def test_redirects_and_robots():
    got, _, _ = fetch({"https://h.example/a": {"status": 301, "headers": {"Location": "/b"}}, "https://h.example/b": {"body": "y"}})
    assert got["snapshot"]["url"] == "https://h.example/b" and got["snapshot"]["redirects"] == ["https://h.example/a"]
    assert fetch({"https://h.example/a": {"status": 302, "headers": {"Location": "/a"}}})[0]["error"]["kind"] == "too-many-redirects"
    rules = {"https://h.example/robots.txt": {"body": "User-agent: *\nDisallow: /a"}, "https://h.example/a": {"body": "x"}}
    assert fetch(rules)[0]["error"]["kind"] == "robots-disallowed" and fetch(rules, {"respect_robots": False})[0]["snapshot"]
    got, _, _ = fetch({"https://h.example/robots.txt": {"status": 500}, "https://h.example/a": {"body": "x"}})
    assert got["snapshot"] and "failing open" in got["warnings"][0]


def test_conditional_requests():
    prior = {"url": "https://h.example/a#x", "etag": "E", "last_modified": None, "body": "old"}
    got, site, _ = fetch({"https://h.example/a": {"status": 304}}, {"revalidate": True}, prior=prior)
    assert got["snapshot"]["not_modified"] and site.asked[-1][1]["If-None-Match"] == "E"
    got, site, _ = fetch({"https://h.example/a": {"status": 304}}, {"revalidate": True}, prior=prior | {"url": "https://h.example/a?q"})
    assert got["error"]["status"] == 304 and "If-None-Match" not in site.asked[-1][1]


def test_rendering():
    shell = {"https://h.example/a": {"body": "shell"}}
    r = lambda url, ms: {"status": 200, "body": "full"}
    got, _, _ = fetch(shell, {"render_policy": "on-shell-warning"}, renderer=r, is_shell=lambda h: h == "shell")
    assert got["snapshot"]["body"] == "full" and got["snapshot"]["rendered"] and got["escalation"]["outcome"] == "rendered"
    got, _, _ = fetch(shell, {"render_policy": "on-shell-warning"}, is_shell=lambda h: True)
    assert got["snapshot"]["body"] == "shell" and got["escalation"]["outcome"] == "renderer-unavailable-fallback"


def test_politeness():
    site, still = Site({f"https://h.example/{k}": {"body": "x"} for k in "abc"}), Still()
    s = fetching.Session(site, still.clock())
    for k in "abc":
        fetching.fetch_one(s, {"source_id": k, "url": f"https://h.example/{k}", "min_delay_ms": 400})
    assert still.slept == [400, 400]


def test_robots_tables_agree_with_the_fetcher(spark):
    bodies = ["User-agent: *\nDisallow: /\n", "User-agent: gristmill\nDisallow: /a\nAllow: /a/b\n\nUser-agent: *\nDisallow: /", "User-agent: grist\nDisallow: /x\nUser-agent: gristmill\nAllow: /x/y", "", "Disallow: /", "user-agent: other\ndisallow: /"]
    files = spark.createDataFrame([(str(k), b, fetching.AGENT) for k, b in enumerate(bodies)], "origin string, body string, agent string")
    paths = ["/", "/a", "/a/b/c", "/x/y", "/z?q"]
    asked = spark.createDataFrame([(f"{k}{p}", str(k), p) for k in range(len(bodies)) for p in paths], "request_id string, origin string, path string")
    got = {r["request_id"]: r["allowed"] for r in robots.decided(asked, robots.parsed(files)).collect()}
    assert got == {f"{k}{p}": fetching.path_allowed(fetching.robots_rules(b, fetching.AGENT), p) for k, b in enumerate(bodies) for p in paths}


SITE = {
    "https://h.example/": '<a href="/about">a</a><a href="gear#x">g</a><a href="https://other.example/">o</a><a href="mailto:x">m</a><a href="#y">s</a>',
    "https://h.example/about": '<a href="/contact">c</a><a href="/gear">g</a>',
    "https://h.example/gear": '<a href="/gear?variant=green">v</a>',
    "https://h.example/contact": '<a href="/deep">d</a>',
    "https://h.example/gear?variant=green": "",
    "https://h.example/deep": "",
}


def test_crawl(spark):
    session = fetching.Session(Site({k: {"body": v} for k, v in SITE.items()}), Still().clock())
    got = crawling.crawl(session, {"source_id": "seed 1", "url": "https://h.example/"})
    path = [(p["url"][17:], p["depth"]) for p in got["pages"]]
    assert path == [("/", 0), ("/about", 1), ("/gear", 1), ("/contact", 2), ("/gear?variant=green", 2)] and not got["truncated"]
    assert got["pages"][1]["result"]["snapshot"]["source_id"] == "seed%201::https://h.example/about"
    cut = crawling.crawl(session, {"source_id": "s", "url": "https://h.example/"}, max_pages=2)
    assert len(cut["pages"]) == 2 and cut["truncated"] and "maxPages cap (2) reached; 2 further" in cut["warnings"][-1]
    from gristmill.functions.markup import same_host_links

    edges = spark.createDataFrame([(u, k, x) for u, h in SITE.items() for k, x in enumerate(same_host_links(h, u))], "page string, pos int, link string")
    rows = crawling.breadth_first(spark.createDataFrame([("s", "https://h.example/")], "seed_id string, url string"), edges).orderBy("seq").collect()
    assert [(r["url"][17:], r["depth"]) for r in rows] == path
    assert crawling.breadth_first(spark.createDataFrame([("s", "https://h.example/")], "seed_id string, url string"), edges, 3).count() == 3


def rows_of(spark, n):
    return spark.createDataFrame(
        [("a", "https://h/x", f"2026-01-0{k}T00:00:00Z", 200, "text", f"b{k}", None, f"{k}" * 64, ["r"], False, None, None, False, False) for k in range(1, n)]
        + [("b", "https://h/y", "2026-01-01T00:00:00Z", 200, "pdf", None, bytearray(b"\x00\xff"), "f" * 64, None, None, None, None, None, None)],
        snapshots.SCHEMA,
    )


def test_snapshot_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    snapshots.put(rows_of(spark, 4), folder)
    (tmp_path / "store" / "foreign.json").write_text('{"x": 1}\nnot json\n')
    back = snapshots.load(spark, folder)
    assert back.count() == 4 and back.where("source_id = 'b'").first()["body_bytes"] == b"\x00\xff"
    assert {r["source_id"]: r["body_hash"][0] for r in snapshots.latest(back).collect()} == {"a": "3", "b": "f"}
    got = snapshots.replayed(spark.createDataFrame([("a",), ("z",)], "source_id string"), back).orderBy("source_id").collect()
    assert got[0]["from_cache"] and got[0]["error"] is None and got[1]["error"] == "no-snapshot"


def test_fetched_table(spark):
    site = Site({f"https://{h}.example/{k}": {"body": f"{h}{k}"} for h in "ab" for k in "xy"})
    sources = spark.createDataFrame([(f"{h}{k}", f"https://{h}.example/{k}", 0) for h in "ab" for k in "xyz"], "source_id string, url string, min_delay_ms int")
    got = {r["source_id"]: r for r in fetching.fetched(sources, site).collect()}
    assert got["ax"]["snapshot"]["body"] == "ax" and got["bz"]["error"]["status"] == 404 and len(got) == 6


def test_references(spark):
    df = spark.createDataFrame([("a b+c/ü", "https://h/x?y=1&z=2", "ab", "2026-01-01T00:00:00.000Z")], "s string, u string, h string, f string")
    ref = U.snapshot_ref(F.col("s"), F.col("u"), F.col("h"), F.col("f"))
    r = df.select(ref.alias("ref"), U.parsed_ref(ref).alias("p"), U.parsed_ref(F.lit("snapshot:a?url=b")).alias("bad")).first()
    assert tuple(r["p"]) == ("a b+c/ü", "https://h/x?y=1&z=2", "ab", "2026-01-01T00:00:00.000Z") and r["bad"] is None and "a%20b%2Bc" in r["ref"]


@pytest.mark.parametrize(
    "url, want", [("https://h/?access_token=x", True), ("https://u:p@h/", True), ("Bearer abc", True), ("https://h/?next=https%3A%2F%2Fh%2F%3Fapi_key%3D1", True), ("https://h/tokens?page=2", False)]
)
def test_credentials(spark, url, want):
    from gristmill.operators.envelope import references_authorization

    assert spark.range(1).select(U.holds_credentials(F.lit(url))).first()[0] is want and references_authorization(url) is want


def test_captions():
    class Tool:
        def metadata(self, url):
            return {"id": "v1"}

        def captions(self, url):
            return [("de", "d"), ("en-orig", "o"), ("en-GB", "g")]

    assert captions.fetch_captions(Tool(), "u", "t")["snapshot"]["body"] == "o"
    assert captions.fetch_captions(None, "u", "t")["error"]["kind"] == "dependency-missing"
    assert captions.tool_line("a\tb\tc\t61.0\n") == {"id": "a", "title": "b", "channel": "c", "duration": 61}


def test_streams(spark, tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    amount = {"input_tokens": 10, "output_tokens": 5, "spend_usd": 0.5}
    events = [{"event": "started", "authorization_digest": "a", "reservation_id": "1", "recorded_at": "t", "reserved": amount}, {"event": "completed", "authorization_digest": "a", "reservation_id": "1", "recorded_at": "t", "usage": amount | {"input_tokens": 2}}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, events)))
    seen = []
    q = flows.ledger_totals_stream(spark, str(folder), lambda df, epoch: seen.append(df.first()["input_tokens"]), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [2]
    shots = tmp_path / "shots"
    shots.mkdir()
    row = {"source_id": "a", "url": "u", "fetched_at": "2026-01-01T00:00:00Z", "status": 200, "content_type": "text", "body": "b", "body_hash": "h"}
    (shots / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"fetched_at": "2026-01-01T01:00:00Z"}))
    q = flows.snapshot_stream(spark, str(shots)).writeStream.format("memory").queryName("shots").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("shots").count() == 1
