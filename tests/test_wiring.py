"""The plan as a whole: calls are paid once, tasks, stores, extractors, cancellation, composition with fetching and crawling."""

import json
import time

import pytest
from pyspark.sql import functions as F

from gristmill import providers
from gristmill.functions import markup
from gristmill.functions import urls as U
from gristmill.operators import envelope, evaluation, ledger, tasks
from gristmill.operators.dispatch import Options
from gristmill.plans import extraction
from gristmill.plans.composition import crawl_and_extract, fetch_and_extract
from gristmill.plans.extraction import SCHEMA, extract
from gristmill.plans.tables import Written, shared_folder
from gristmill.sources import crawling, fetching, snapshots

FIELDS = [("title", "string", None, None, True, None)]


def documents(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"run_id {kind}, source_ref string, content string, content_type string")


def fields(spark):
    return spark.createDataFrame(FIELDS, SCHEMA)


class Counting:
    """Writes a line to a file for every call."""

    name = "counting"

    def __init__(self, path):
        self.path = str(path)

    def extract(self, request):
        with open(self.path, "a") as f:
            f.write("x\n")
        return {"proposals": [{"field_path": "title", "value": "Marker", "confidence": 0.5, "excerpt": "Marker", "extractor": "c"}], "tokens": 1}

    @property
    def calls(self):
        try:
            return len(open(self.path).readlines())
        except FileNotFoundError:
            return 0


def test_a_chunk_is_one_call_whatever_is_read(spark, tmp_path):
    p = Counting(tmp_path / "calls")
    docs = documents(spark, [(k, "s", "Marker " * (3 + k), "text") for k in range(6)])
    e = extract(docs, fields(spark), p, size=20, overlap=0)
    assert p.calls == 0
    chunks = e.chunks.count()
    assert e.kept.count() and e.results.count() == 6 and e.outcomes.count() == chunks and e.proposals.count() == chunks
    assert e.kept.count() and len(e.results.collect()) == 6
    assert p.calls == chunks
    e.release()


def test_prepared_texts_are_written_once_and_released(spark, tmp_path):
    e = extract(documents(spark, [(1, "s", "Marker", "text")]), fields(spark), Counting(tmp_path / "c"))
    assert e.results.count() == 1 and len(e.written.paths) == 3
    paths = [p.removeprefix("file:") for p in e.written.paths]
    import os

    assert all(os.path.exists(p) for p in paths)
    e.release()
    assert not any(os.path.exists(p) for p in paths)


def test_text_run_ids(spark):
    e = extract(documents(spark, [("a", "s", "Marker; Marker", "text"), ("b", "s", "", "text")], "string"), fields(spark), providers.DictionaryScan("title", ["Marker"]))
    assert [(r["run_id"], r["locator"]) for r in e.kept.collect()] == [("a", "chars:0-6")]
    assert {r["run_id"]: r["provider_calls"] for r in e.results.collect()} == {"a": 1, "b": 0}


def test_order_of_what_is_wrong(spark):
    docs = documents(spark, [(1, "s", "Marker", "text")])
    p = providers.DictionaryScan("title", ["Marker"])
    p.capabilities = ["structured-output"]
    assert extract(docs, fields(spark), p, Options(max_calls=0)).results.first()["error"] == 'provider dictionary does not support required capability "exact-excerpts"'
    p.capabilities = ["structured-output", "exact-excerpts"]
    assert extract(docs, fields(spark), p, Options(max_calls=0)).results.first()["error"].startswith("invalid maxProviderCalls")
    good = tasks.create({"version": "1", "target_schema": [f.asDict() for f in fields(spark).collect()], "guidance": "be exact", "examples": []})
    assert extract(docs, fields(spark), p, task=good).results.first()["error"] == 'provider dictionary does not support required capability "task-specifications"'
    bad = extract(docs, fields(spark), p, Options(max_calls=0), task=good | {"version": ""})
    r = bad.results.first()
    assert r["error"].startswith("invalid taskSpec: ") and r["provider_calls"] == 0 and bad.outcomes.count() == 0


class Guided:
    name, capabilities = "guided", ["structured-output", "exact-excerpts", "task-specifications"]

    def extract(self, request):
        found = [request["guidance"]] + [e["content"] for e in request["examples"]]
        return {"proposals": [{"field_path": "title", "value": x, "confidence": 1, "excerpt": x, "extractor": "g"} for x in found]}


def test_tasks_reach_the_provider(spark):
    schema = [f.asDict() for f in fields(spark).collect()]
    task = tasks.create({"version": "1", "target_schema": schema, "guidance": "Marker", "examples": [{"content": "an example", "proposals": []}]})
    e = extract(documents(spark, [(1, "s", "Marker in an example", "text")]), fields(spark), Guided(), task=task)
    r = e.results.first()
    assert {x["value_json"] for x in e.kept.collect()} == {'"Marker"', '"an example"'}
    assert r["task_digest"] == task["digest"] and r["example_digests"] == [task["examples"][0]["digest"]]
    line = envelope.envelopes(e.results, e.kept, F.lit("00000000-0000-4000-8000-000000000001"), F.lit("2026")).first()["line"]
    assert envelope.validate(json.loads(line)) is None and json.loads(line)["result"]["taskDigest"] == task["digest"]


def test_store_and_its_failure(spark):
    docs, held = documents(spark, [(1, "s", "Marker", "text"), (2, "s", None, "pdf")]), []
    e = extract(docs, fields(spark), providers.DictionaryScan("title", ["x"]), store=lambda df: held.extend(df.collect()))
    r = {x["run_id"]: x for x in e.results.collect()}
    assert [(x["ref"], x["text"]) for x in held] == [(r[1]["artifact"]["ref"], "Marker")] and r[2]["artifact"] is None

    def fail(df):
        raise OSError("disk")

    r = extract(docs, fields(spark), providers.DictionaryScan("title", ["x"]), store=fail).results.where("run_id = 1").first()
    assert r["warnings"] == [extraction.STORAGE] and r["error"] is None


def test_cancellation(spark):
    e = extract(documents(spark, [(1, "s", "x" * 30, "text")]), fields(spark), providers.DictionaryScan("title", ["y"]), size=10, overlap=0, cancelled=lambda: True)
    r = e.results.first()
    assert r["partial"].asDict() == {"reason": "cancelled", "completed": 0, "remaining": 3, "token_overshoot": None} and r["provider_calls"] == 0 and r["error"] is None
    assert r["warnings"] == ["stopped after 0 provider call(s): cancelled; 3 chunk(s) not processed", "chunked into 3 chunks by character window"]


def test_pdf_and_image_extractors(spark):
    def read(data):
        if data == b"broken":
            raise ValueError("no pages")
        return {
            "text": data.decode(), "page_offsets": [0, 4], "warnings": "not a list" if data == b"odd one" else ["scanned"],
            "layout": {"pages": [{"page_number": 1}], "elements": [{"kind": "p", "page_number": 1, "start": 0, "end": 4 if data != b"odd one" else 99}], "tables": []},
        }

    rows = [(1, "a", None, "pdf", b"Marker here"), (2, "b", None, "pdf", b"broken"), (3, "c", "text", "pdf", None), (4, "d", None, "png", b"Marker"), (5, "e", None, "pdf", b"odd one"), (6, "f", None, "text", b"x")]
    docs = spark.createDataFrame(rows, "run_id bigint, source_ref string, content string, content_type string, content_bytes binary")
    e = extract(docs, fields(spark), providers.DictionaryScan("title", ["Marker"]), pdf_text=read, image_text=read)
    r = {x["run_id"]: x for x in e.results.collect()}
    assert r[1]["pdf_page_offsets"] == [0, 4] and r[1]["pdf_layout"]["elements"][0]["end"] == 4 and r[1]["artifact"]["preparation_mode"] == "pdf-text" and r[1]["warnings"] == ["scanned"]
    assert r[2]["error"] == "pdf text extraction failed: no pages" and r[2]["provider_calls"] == 0 and "requires bytes" in r[3]["error"] and "binary content" in r[6]["error"]
    assert r[4]["ocr_derived"] and r[4]["artifact"]["preparation_mode"] == "image-ocr" and r[4]["n_proposals"] == 1
    assert r[5]["pdf_layout"] is None and r[5]["warnings"] == ["dropped extractor-reported warnings: not an array of strings", "dropped pdfLayout: malformed or out-of-range layout mapping"]
    lines = envelope.envelopes(e.results, e.kept, F.lit("00000000-0000-4000-8000-000000000001"), F.lit("2026")).collect()
    assert all(envelope.validate(json.loads(x["line"])) is None for x in lines)


def test_provider_failures_in_envelopes(spark):
    class Failing:
        name = "failing"

        def extract(self, request):
            e = RuntimeError("no")
            e.status, e.code = 401, "auth"
            raise e

    e = extract(documents(spark, [(1, "s", "Marker", "text")]), fields(spark), Failing())
    line = json.loads(envelope.envelopes(e.results, e.kept, F.lit("00000000-0000-4000-8000-000000000001"), F.lit("2026")).first()["line"])
    assert line["result"]["outcome"] == {"status": "failure", "category": "provider", "code": "provider-failure"}
    assert line["result"]["providerFailures"] == [{"provider": "failing", "kind": "authentication", "retryable": False}] and envelope.validate(line) is None


def test_artifact_states(spark):
    a = {"format": "prepared-artifact", "version": 1, "digest": "0" * 64, "ref": "prepared-artifact:v1:sha256:" + "1" * 64, "preparationMode": "text", "preparationVersion": "1", "contentLength": 3}
    assert envelope.artifact_state({"status": "available", "artifact": a}, a) == {"status": "available", "requestedRef": a["ref"], "canonicalRef": a["ref"]}
    other = a | {"ref": "prepared-artifact:v1:sha256:" + "2" * 64}
    assert envelope.artifact_state({"status": "identity-mismatch", "artifact": other}, a)["requestedRef"] == other["ref"]
    assert envelope.artifact_state({"status": "invalid-artifact", "reason": "digest"}, a) == {"status": "invalid-artifact", "reason": "digest", "canonicalRef": a["ref"]}
    assert envelope.artifact_state({"status": "digest-mismatch", "artifact": a, "actual_digest": "x", "actual_content_length": 4}, a)["actualContentLength"] == 4
    for wrong, own in (({"status": "available", "artifact": other}, a), ({"status": "available", "artifact": a}, None), ({"status": "identity-mismatch", "artifact": other | {"contentLength": 4}}, a)):
        with pytest.raises(TypeError):
            envelope.artifact_state(wrong, own)


# composition


def still():
    return fetching.Clock(now=lambda: 0.0, sleep=lambda ms: None, draw=lambda: 0.5, stamp=lambda: "2026-01-01T00:00:00.000Z")


def client(url, headers, timeout_ms):
    if url.endswith("/gone"):
        return {"status": 404}
    return {"status": 200, "headers": {"content-type": "text/plain", "etag": "v1"}, "body": f"Marker of {url}"}


def test_capture_and_replay(spark, tmp_path):
    store = f"{tmp_path}/store"
    sources = spark.createDataFrame([("a", "https://h.example/a", 0, False), ("b", "https://h.example/gone", 0, False)], "source_id string, url string, min_delay_ms int, respect_robots boolean")
    p = providers.DictionaryScan("title", ["Marker"])
    live = fetch_and_extract(sources, fields(spark), p, mode="live-with-capture", client=client, clock=still(), store=store)
    told = {r["source_id"]: r for r in live.fetched.collect()}
    assert told["b"]["error"]["kind"] == "http-error" and told["b"]["snapshot_ref"] is None
    r = live.extraction.results.collect()
    assert [(x["run_id"], x["source_ref"], x["artifact"]["source_snapshot_ref"]) for x in r] == [("a", told["a"]["snapshot_ref"], told["a"]["snapshot_ref"])]
    again = fetch_and_extract(sources, fields(spark), p, mode="replay", store=store)
    assert [x["artifact"]["ref"] for x in again.extraction.results.collect()] == [r[0]["artifact"]["ref"]]
    assert {x["source_id"]: x["error"] and x["error"]["kind"] for x in again.fetched.collect()} == {"a": None, "b": "no-snapshot"}
    with pytest.raises(ValueError):
        fetch_and_extract(sources, fields(spark), p, mode="replay")
    live.release()


def test_crawl_and_extract(spark):
    pages = {"/": '<a href="/b">b</a> <a href="/c#x">c</a> <span><a href="https://else.example/">e</a></span> Marker', "/b": '<a href="/d">d</a> nothing', "/c": "Marker Marker", "/d": "Marker"}

    def site(url, headers, timeout_ms):
        path = url.removeprefix("https://s.example") or "/"
        return {"status": 200, "headers": {"content-type": "text/html"}, "body": f"<html><body><p>{pages[path]}</p></body></html>"} if path in pages else {"status": 404}

    manifest = crawling.crawl(fetching.Session(site, still()), {"source_id": "seed", "url": "https://s.example/", "min_delay_ms": 0}, max_pages=3)
    assert [p["url"] for p in manifest["pages"]] == ["https://s.example/", "https://s.example/b", "https://s.example/c"] and manifest["truncated"]
    c = crawl_and_extract(manifest, spark, fields(spark), providers.DictionaryScan("title", ["Marker"]))
    got = {r["run_id"]: r for r in c.extraction.results.collect()}
    assert [got[k]["n_proposals"] for k in range(3)] == [1, 0, 1] and all("snapshot:seed" in got[k]["source_ref"] for k in range(3))
    assert c.fetched.orderBy("run_id").first()["depth"] == 0


def test_shell_pages_escalate_in_the_table_fetcher(spark):
    shell = '<html><body><div id="app"></div><script>' + "x" * 3000 + "</script></body></html>"
    with_state = shell.replace("<body>", '<body><script type="application/ld+json">{"a":1}</script>')
    bodies = {"a": shell, "b": with_state, "c": "<p>" + "words " * 400 + "</p>"}

    def get(url, headers, timeout_ms):
        return {"status": 200, "headers": {"content-type": "text/html"}, "body": bodies[url[-1]]}

    sources = spark.createDataFrame([(k, f"https://h.example/{k}", "on-shell-warning", 0, False) for k in bodies], "source_id string, url string, render_policy string, min_delay_ms int, respect_robots boolean")
    got = {r["source_id"]: r for r in fetching.fetched(sources, get, lambda url, ms: {"status": 200, "body": "full"}, still()).collect()}
    assert {k: got[k]["escalation"]["outcome"] for k in bodies} == {"a": "rendered", "b": "not-needed", "c": "not-needed"}
    assert got["a"]["snapshot"]["body"] == "full" and got["a"]["escalation"]["first_ref"].startswith("snapshot:a?url=")


def test_references_as_the_fetcher_writes_them(spark):
    shot = {"source_id": "a b+c/ü!'(~)*", "url": "https://h/x~y?q=1 2&z=*", "body_hash": "ab", "fetched_at": "2026-01-01T00:00:00.000Z"}
    df = spark.createDataFrame([tuple(shot.values())], ", ".join(f"{k} string" for k in shot))
    assert df.select(U.snapshot_ref(*[F.col(k) for k in shot])).first()[0] == fetching._ref(shot)


# the contracts of pieces


@pytest.mark.parametrize(
    "ref, want",
    [
        ("https://h/?credential=x", True), ("https://h/?passwd=x", True), ("https://h/?key=1", False), ("https://h/?mytoken=1", False), ("https://h/?my-token=1", True), ("authorization: x", True), ("token=x", False),
        ("https://h/?next=https%3A%2F%2Fu%3Ap%40h", True), ("https://h/?a=b:c", False), ("https://h/?a=http://h/?a=http://h/?a=http://h/", True), ("bearer of news", True), ("https://h/#token=1", False),
    ],
)
def test_authorization_in_references(spark, ref, want):
    assert U.references_authorization(ref) is want
    assert spark.range(1).select(U.holds_credentials(F.lit(ref))).first()[0] is want


def test_items_out_of_range():
    got, warnings = providers.parse_items({"proposals": [{"field_path": " a ", "value": None, "confidence": 7, "excerpt": "x"}, {"field_path": " a ", "value": None, "confidence": 1, "excerpt": " x ", "occurrence_hint": 2.0}]}, "n")
    assert got == [{"field_path": "a", "value": None, "confidence": 1, "excerpt": "x", "extractor": "n", "occurrence_hint": 2}]
    assert warnings == ['dropped malformed tool item at index 0 (fieldPath "a"): missing/out-of-range confidence'] and providers.parse_items({}, "n") == ([], [])


def test_relay_batches():
    asked = []

    def batch(requests):
        asked.append(len(requests))
        return [{"arguments": {"proposals": []}, "input_tokens": 1} for _ in requests]

    from gristmill.operators.dispatch import run_waves

    r = providers.Relay(None, batch=batch, max_batch=2, strict=True)
    out, calls, tokens, _ = run_waves(r, [{"chunk": str(k)} for k in range(6)], "text", [{"path": "a", "type": "string"}], Options(batch=5))
    assert asked == [2, 2, 2] and calls == 3 and tokens == 6 and len(out) == 6
    out, *_ = run_waves(r, [{"chunk": "a"}, {"chunk": "b"}], "text", [{"path": "a", "type": "array"}], Options(batch=2))
    assert all(isinstance(x, ValueError) for x in out.values())
    assert not hasattr(providers.Relay(None), "extract_batch")


def test_call_chars_count_units_of_utf16():
    from gristmill.operators.dispatch import u16_head, u16_size

    assert u16_head("a😀b", 2) == "a" and u16_head("a😀b", 3) == "a😀" and u16_size("a😀b") == 4 and u16_head("ab", 5) == "ab"


def test_passes_share_their_budget():
    def run(k, calls, tokens, before):
        return {"proposals": [k, len(before)], "provider_calls": 2, "total_tokens_used": 6}

    done, budget = evaluation.passes(run, 3, 3, 100)
    assert [r["proposals"] for r in done] == [[0, 0], [1, 2]] and budget == {"attempts": 2, "calls": 4, "tokens": 12, "token_overshoot": 0, "later_pass_skipped": True}
    assert evaluation.passes(run, 2, 9, 5)[1]["token_overshoot"] == 1


def test_ledger_stream_totals_grow(spark, tmp_path):
    from gristmill.streaming.flows import ledger_totals_stream

    folder, seen = tmp_path / "events", []
    folder.mkdir()
    amount = {"input_tokens": 10, "output_tokens": 5, "spend_usd": 0.25}

    def event(kind, k, **x):
        return json.dumps({"event": kind, "authorization_digest": "a", "reservation_id": str(k), "recorded_at": "t"} | x) + "\n"

    def go():
        q = ledger_totals_stream(spark, str(folder), lambda df, n: seen.append(df.first().asDict()), f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    (folder / "1.json").write_text(event("started", 1, reserved=amount) + event("started", 2, reserved=amount))
    go()
    (folder / "2.json").write_text(event("completed", 1, usage={"input_tokens": 3, "output_tokens": 1, "spend_usd": 0.0}))
    go()
    (folder / "3.json").write_text(event("started", 3, reserved=amount))
    go()
    assert [(r["provider_calls"], r["input_tokens"], r["started"], r["completed"]) for r in seen] == [(2, 20, 2, 0), (2, 13, 1, 1), (3, 23, 2, 1)]
    whole = ledger.totals(spark.read.schema(ledger.EVENTS).json(str(folder))).first().asDict()
    assert whole == seen[-1]


def test_markup_is_linear_on_odd_pages():
    pages = {
        "items": "<ol>" + "<li>x</li>" * 20_000 + "</ol>", "open": "<div>" * 20_000, "crossed": "<b><i>" * 5000 + "</b></i>" * 5000, "scripts": "<script>" * 20_000, "spans": '<span class="a">x</span>' * 20_000,
        "quotes": "<blockquote>" * 300 + "x", "attributes": '<a href="' + "x" * 200_000, "state": '<script>window.__INITIAL_STATE__ = {' + "[" * 100_000 + "</script>",
    }
    for name, html in pages.items():
        began = time.time()
        markup.structural_chunks(html)
        markup.embedded_state(html)
        assert time.time() - began < 10, name
    assert markup.html_markdown("<ol><li>a</li><li>b<ol><li>c</li></ol></li><li>d</li></ol>") == "1. a\n2. b\n   1. c\n3. d"


def test_shared_folder_must_be_shared(spark):
    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_folder(Session())
    assert shared_folder(spark)
    w = Written(spark)
    assert w(spark.range(3)).count() == 3
    w.release()


def test_prior_snapshots_of_the_store(spark):
    rows = [("a", "https://h/1", "2026", 200, "text", "x", None, "h1"), ("a", "https://h/2", "2027", 200, "text", "y", None, "h2"), ("b", None, "2027", 200, "text", "y", None, "h3")]
    df = spark.createDataFrame(rows, "source_id string, url string, fetched_at string, status int, content_type string, body string, body_bytes binary, body_hash string")
    assert snapshots.well_formed(df).count() == 2 and snapshots.latest(df.where("source_id = 'a'")).first()["body_hash"] == "h2"
    assert [r["place"] for r in snapshots.listed(df.where("source_id = 'a'")).orderBy("fetched_at").collect()] == [2, 1]
