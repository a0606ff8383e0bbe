"""Grounding, dispatch, artifacts, envelopes, evaluation, ledger, layout, the extraction plan."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import canonical, markup
from gristmill.operators import artifacts, envelope, evaluation, grounding, ledger, outcomes, pdf, tasks
from gristmill.operators.dispatch import Options, run_waves
from gristmill.plans.extraction import SCHEMA, extract
from gristmill.providers import DictionaryScan, PatternScan, Relay, parse_items, strict_schema, tool

P = "run_id bigint, seq bigint, field_path string, value_canon string, confidence double, excerpt string, extractor string, occurrence_hint int, visible_start bigint, visible_end bigint"


def ground(spark, rows, fields=(("title", "string"), ("terms[].name", "string"))):
    schema = spark.createDataFrame([(p, t, None, None) for p, t in fields], "path string, type string, enum_values array<string>, inference_type string")
    # rows of one text are one run
    texts = {t: k for k, t in enumerate(dict.fromkeys(r[-1] for r in rows))}
    proposals = spark.createDataFrame([(texts[r[-1]], *r[:-1]) for r in rows], P)
    table = spark.createDataFrame([(k, t) for t, k in texts.items()], "run_id bigint, full_text string")
    return {r["seq"]: r for r in grounding.normalized(proposals, table, schema).collect()}


def row(seq, excerpt="Marker", text="Marker; Marker", hint=None, path="title", value="v", confidence=0.5, visible=None, start=0, extractor="x"):
    return (seq, path, value, confidence, excerpt, extractor, hint, start, start + len(text if visible is None else visible), text)


def test_unhinted_proposals_take_occurrences_in_order(spark):
    got = ground(spark, [row(0), row(1), row(2), row(3, value="w")])
    assert [got[k]["locator"] for k in range(4)] == "chars:0-6 chars:8-14 chars:8-14 chars:0-6".split()


def test_hints(spark):
    got = ground(spark, [row(0, hint=2), row(1, hint=3, value="w"), row(2, hint=1, value="u", text="xx Marker......Marker", visible="...Marker", start=12)])
    assert (got[0]["locator"], got[0]["occurrence"]["selection"], got[0]["occurrence"]["hint_used"]) == ("chars:8-14", "occurrence-hint", True)
    assert (got[1]["locator"], got[1]["occurrence"]["selection"]) == ("chars:0-6", "source-order")
    assert got[2]["locator"] == "chars:15-21" and got[2]["occurrence"]["count"] == 2


def test_gates_in_order(spark):
    rows = [row(0, path=" "), row(1, path="no"), row(2, extractor=" "), row(3, excerpt=" "), row(4, excerpt="absent"), row(5, confidence=float("nan")), row(6, confidence=1.7), row(7, path="terms[3].name")]
    got = ground(spark, rows)
    assert [got[k]["drop_reason"] for k in range(8)] == ["missing-field-path", "unknown-field-path", "missing-extractor", "missing-excerpt", "excerpt-not-found", "non-numeric-confidence", None, None]
    # the one with a bad confidence has taken the first occurrence
    assert got[6]["locator"] == "chars:8-14" and got[6]["confidence"] == 1.0 and got[6]["warning"].startswith("clamped") and got[7]["path_indices"] == [3]


def test_overlapping_windows_share_occurrences(spark):
    text = "." * 85 + "MARKER" + "." * 100
    rows = [row(0, "MARKER", text, visible=text[:100]), row(1, "MARKER", text, visible=text[80:180], start=80)]
    got = ground(spark, rows)
    assert {got[0]["locator"], got[1]["locator"]} == {"chars:85-91"}
    kept = grounding.deduplicated(spark.createDataFrame([(1, k, "title", None, "v", "chars:85-91", c) for k, c in ((0, 0.6), (1, 0.9), (2, 0.9))], "run_id int, seq int, field_path string, path_indices array<int>, value_canon string, locator string, confidence double")).collect()
    assert [(r["seq"], r["position"], r["duplicates"]) for r in kept] == [(1, 0, 2)]


class Scripted:
    name = "scripted"

    def __init__(self, tokens=100, fail=()):
        self.tokens, self.fail, self.calls = tokens, set(fail), 0

    def extract(self, request):
        self.calls += 1
        if request["content"] in self.fail:
            raise RuntimeError("timeout talking to it")
        return {"proposals": [], "tokens": self.tokens}


CHUNKS = [{"chunk": str(k)} for k in range(6)]


def test_token_ceiling_and_calls():
    out, calls, tokens, stop = run_waves(Scripted(), CHUNKS, "text", [], Options(max_tokens=250))
    assert (len(out), calls, tokens, stop) == (3, 3, 300, ("max-total-tokens", 3))
    out, calls, tokens, stop = run_waves(Scripted(), CHUNKS, "text", [], Options(max_calls=2, concurrency=4))
    assert (len(out), calls, stop) == (2, 2, ("max-provider-calls", 4))
    out, calls, _, stop = run_waves(Scripted(fail={"0"}), CHUNKS, "text", [], Options())
    assert isinstance(out[0], RuntimeError) and calls == 6 and stop is None
    assert run_waves(Scripted(), CHUNKS, "text", [], Options(), lambda: True)[3] == ("cancelled", 6)


@pytest.mark.parametrize("batch, concurrency", [(1, 1), (2, 1), (3, 2), (10, 3)])
def test_batches_and_waves_give_the_same_outcomes(batch, concurrency):
    p = DictionaryScan("t", ["1", "4"])
    out, calls, tokens, stop = run_waves(p, CHUNKS, "text", [], Options(batch=batch, concurrency=concurrency))
    assert [len(out[k]["proposals"]) for k in range(6)] == [0, 1, 0, 0, 1, 0] and calls == -(-6 // batch) and tokens == 42


def test_options_and_capabilities():
    assert Options(max_calls=0).error().startswith("invalid maxProviderCalls") and Options(batch=0).error().startswith("invalid batchSize") and Options().error() is None
    assert outcomes.missing_capability(["structured-output"]) == "exact-excerpts" and outcomes.missing_capability(None) is None


def documents(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, source_ref string, content string, content_type string")


def fields(spark):
    return spark.createDataFrame([("title", "string", None, None, True, None)], SCHEMA)


PAGE = "<html><body><h1>T</h1><div>" + "".join(f'<article class="card"><h2>Item {i}</h2><a href="/x{i}">Marker</a></article>' for i in range(12)) + "</div></body></html>"


def test_plan_end_to_end(spark):
    docs = documents(spark, [(1, "a", "Marker; Marker", "text"), (2, "b", PAGE, "html"), (3, "c", None, "pdf"), (4, "d", "😀 Marker " * 30, "text"), (5, "e", "", "text")])
    e = extract(docs, fields(spark), DictionaryScan("title", ["Marker", "Item 3"]), size=100, overlap=20)
    text = {r["run_id"]: r["full_text"] for r in e.prepared.collect()}
    for r in e.kept.collect():
        s, t = map(int, r["locator"][6:].split("-"))
        assert text[r["run_id"]].encode("utf-16-le")[2 * s : 2 * t].decode("utf-16-le") == r["excerpt"]
    result = {r["run_id"]: r for r in e.results.collect()}
    assert result[2]["n_proposals"] >= 2 and result[2]["provider_calls"] > 1 and any("repeated-card structure (12 cards detected)" in w for w in result[2]["warnings"])
    assert "binary content" in result[3]["error"] and result[3]["provider_calls"] == 0 and result[5]["provider_calls"] == 0
    lines = envelope.envelopes(e.results, e.kept, F.lit("00000000-0000-4000-8000-000000000001"), F.lit("2026-01-01T00:00:00.000Z"))
    checked = lines.withColumn("why", envelope.invalid_reason(F.col("line"))).collect()
    assert [r["why"] for r in checked] == [None] * 5
    again = envelope.deserialize(checked[0]["line"])
    assert envelope.serialize(again) == checked[0]["line"]
    for change in ({"version": 2}, {"x": 1}, {"source": {"ref": "https://u:p@h/"}}):
        assert envelope.validate(again | change)


def test_plan_budget_and_wrong_options(spark):
    docs = documents(spark, [(1, "a", "x" * 60, "text")])
    r = extract(docs, fields(spark), DictionaryScan("title", ["y"]), Options(max_calls=2), size=10, overlap=0).results.first()
    assert r["partial"].asDict() == {"reason": "max-provider-calls", "completed": 2, "remaining": 4, "token_overshoot": None} and r["provider_calls"] == 2
    r = extract(docs, fields(spark), DictionaryScan("title", ["y"]), Options(max_calls=0)).results.first()
    assert r["error"].startswith("invalid maxProviderCalls") and r["provider_calls"] == 0
    e = extract(docs, fields(spark), Scripted(fail={"x" * 60}))
    r = e.results.first()
    assert r["error"] == "timeout talking to it" and r["warnings"] == [] and e.kept.count() == 0
    assert [x.asDict() for x in r["provider_failures"]] == [{"provider": "scripted", "kind": "timeout", "retryable": True, "message": "timeout talking to it"}]


def test_artifacts(spark):
    df = spark.createDataFrame([("Alpha then Alpha",)], "t string").select(artifacts.artifact(F.col("t"), F.lit("text"), F.lit("snapshot:fixture-v1")).alias("a"))
    a = df.first()["a"]
    assert a["digest"] == "0cba7385060c5667414b6f19f8b5d7d7b8ca229e14f1d62a4816688d495f2a31" and a["content_length"] == 16
    v = df.select(artifacts.validated(F.col("a"))["status"], artifacts.validated(F.col("a").withField("content_length", F.lit(17).cast("bigint")))["status"], artifacts.validated(F.col("a").withField("digest", F.lit("x")))["reason"]).first()
    assert tuple(v) == ("valid", "identity-mismatch", "digest")


def test_tasks():
    schema = [{"path": "t", "type": "enum", "enum_values": ["a"]}]
    task = tasks.create({"version": "1", "target_schema": schema, "examples": [{"content": "it is a", "proposals": [{"field_path": "t", "value": "a", "excerpt": "is a"}]}]})
    assert tasks.problem(task, schema) is None and task["digest"].startswith("sha256:")
    assert "version" in tasks.problem(task | {"version": " "}, schema) and "digest" in tasks.problem(task | {"guidance": "g"}, schema)
    bad = tasks.create({"version": "1", "target_schema": schema, "examples": [{"content": "it is a", "proposals": [{"field_path": "t", "value": "b", "excerpt": "is a"}]}]})
    assert "type enum" in tasks.problem(bad, schema)


def test_canonical():
    assert canonical.dumps({"b": 1.0, "a": [1.5, -0.0, 1e21, 1e-7]}) == '{"a":[1.5,0,1e+21,1e-7],"b":1}'
    assert canonical.stable(1) != canonical.stable("1") and canonical.stable({"a": 1, "b": 2}) == canonical.stable({"b": 2, "a": 1})


def test_providers():
    got, warnings = parse_items({"proposals": [{"field_path": "a", "value": 1, "confidence": 0.5, "excerpt": "x"}, {"value": 1}, 3]}, "n")
    assert len(got) == 1 and got[0]["extractor"] == "n" and len(warnings) == 2
    r = Relay(lambda m, t, n: {"arguments": {"proposals": []}, "stop_reason": "length", "input_tokens": 3, "output_tokens": 4}, base_url="https://h.example/v1")
    out = r.extract({"content": "c", "schema": [{"path": "a", "type": "string"}]})
    assert out["tokens"] == 7 and "truncated" in out["warnings"][0] and r.name == "relay@h.example"
    assert "a (string)" in tool([{"path": "a", "type": "string"}])["description"]
    with pytest.raises(ValueError):
        strict_schema([{"path": "a", "type": "array"}])
    assert [p["occurrence_hint"] for p in PatternScan("a", "x").extract({"content": "x x"})["proposals"]] == [1, 2]


def test_markup():
    md = markup.html_markdown("<body><nav>n</nav><h2>A <b>b</b></h2><p>one<br>two <a href='/x'>l</a><ul><li>p<li>q<ul><li>r</ul></ul><pre>c\n d</pre><script>s</script></body>")
    assert "## A **b**" in md and "[l](/x)" in md and "- p\n- q\n  - r" in md and "```\nc\n d\n```" in md and "n" not in md.split("\n")[0][:1] and "<" not in md
    got = markup.structural_chunks(PAGE, 60)
    assert got["structural"] and got["card_count"] == 12 and got["chunks"][0][0].startswith("# T")
    for (t, s, e), nxt in zip(got["chunks"], got["chunks"][1:]):
        assert got["full_text"][s:e] == t and nxt[1] == e + 2
    deep = "<div>" * 5000 + "x"
    assert markup.html_markdown(deep) == "x"


def test_embedded_state():
    page = (
        '<script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{bad</script><script id="__NEXT_DATA__">{"p":{"x":"}"}}</script>'
        '<script>window.__INITIAL_STATE__ = {"s":"a}b"}; more()</script>'
    )
    got = markup.embedded_state(page)
    assert got["json_ld"] == ['{"a":1}'] and json.loads(got["next_data"]) == {"p": {"x": "}"}} and got["initial_state"] == '{"s":"a}b"}' and len(got["warnings"]) == 1
    big = "".join(f'<script type="application/ld+json">["{"x" * n}"]</script>' for n in (200_000, 100_000, 1000))
    assert [len(x) for x in markup.embedded_state(big)["json_ld"]] == [200_004, 1004]


def test_layout(spark):
    df = spark.createDataFrame([([0, 10, 20], "x" * 30), ([0, 40], "x" * 30), ([5, 2], "x" * 30)], "o array<bigint>, t string")
    assert [r[0] for r in df.select(pdf.valid_offsets(F.col("o"), F.col("t"))).collect()] == [[0, 10, 20], None, None]
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*[pdf.page_of(F.array(F.lit(0), F.lit(10)), F.lit(k)) for k in (-1, 0, 9, 10, 99)]))).collect()] == [None, 1, 1, 2, 2]
    spans = spark.createDataFrame([(1, 1, "chars:0-10"), (1, 2, "chars:19-30"), (1, 3, "pages:1"), (1, 4, "chars:5-5"), (1, 5, "chars:0-9000")], "doc_id int, span_id int, locator string")
    el = spark.createDataFrame([(1, 7, 10, 20), (1, 8, 4090, 9100)], "doc_id int, element_id int, start bigint, end bigint")
    got = {r["span_id"]: (r["status"], r["reason"], r["elements"]) for r in pdf.resolved_spans(spans, el).collect()}
    assert got == {1: ("not-found", None, None), 2: ("matched", None, [7]), 3: ("invalid-locator", "unsupported-scheme", None), 4: ("invalid-locator", "malformed-range", None), 5: ("matched", None, [7, 8])}


def test_layout_validation(spark):
    kind = "struct<pages:array<struct<page_number:int,width:double,height:double>>,elements:array<struct<kind:string,page_number:int,start:bigint,end:bigint,bounds:struct<x:double,y:double,width:double,height:double>>>,tables:array<struct<page_number:int,cells:array<struct<row_index:int,column_index:int,start:bigint,end:bigint,bounds:struct<x:double,y:double,width:double,height:double>>>>>>"
    page, good = [(1, 100.0, 100.0)], [("b", 1, 5, 9, None), ("a", 1, 0, 3, (1.0, 1.0, 9.0, 9.0))]
    cells = [(1, 0, 4, 5, None), (0, 0, 0, 2, None)]
    rows = [(page, good, [(1, cells)]), (page, [("a", 1, 0, 99, None)], []), (page, [("a", 1, 0, 3, (95.0, 0.0, 9.0, 9.0))], []), (page, good, [(1, [cells[0], cells[0]])]), (page * 2, good, [])]
    df = spark.createDataFrame([(k, v, "x" * 10) for k, v in enumerate(rows)], f"k int, v {kind}, t string")
    got = [r["x"] for r in df.select("k", pdf.valid_layout(F.col("v"), F.col("t")).alias("x")).orderBy("k").collect()]
    assert [e["kind"] for e in got[0]["elements"]] == ["a", "b"] and [c["row_index"] for c in got[0]["tables"][0]["cells"]] == [0, 1] and got[1:] == [None] * 4


def test_ledger(spark):
    amount = {"input_tokens": 10, "output_tokens": 5, "spend_usd": 0.25}
    used = {"input_tokens": 3, "output_tokens": 9, "spend_usd": 0.125}
    rows = []
    for k, end in enumerate([None, "completed", "failed", "locally-rejected"]):
        rows.append(("started", "a", str(k), "t", amount, None))
        if end:
            rows.append((end, "a", str(k), "t", None, used))
    got = ledger.totals(spark.createDataFrame(rows, ledger.EVENTS)).first()
    assert (got["provider_calls"], got["input_tokens"], got["output_tokens"], got["started"], got["locally_rejected"]) == (3, 10 + 3 + 10, 5 + 9 + 9, 1, 1)
    asked = spark.createDataFrame([("a", k, 10, 5, 0.25) for k in range(4)], "authorization_digest string, seq int, input_tokens int, output_tokens int, spend_usd double")
    ok = {r["seq"]: r["admitted"] for r in ledger.admitted(asked, 2, 100, 9.0).collect()}
    assert ok == {0: True, 1: True, 2: False, 3: False}
    odd = spark.createDataFrame([("completed", "a", "9", "t", None, used)], ledger.EVENTS)
    assert ledger.reservations(odd).first()["problem"] == "settlement precedes reservation"


def test_evaluation(spark):
    gold = spark.createDataFrame([("x Marker Marker", "Marker", 2)], "text string, excerpt string, occurrence int")
    assert evaluation.gold_locators(gold).first()["locator"] == "chars:9-15"
    rows = [("number", "1.5", True), ("number", '"1"', False), ("array", "[1]", True), ("object", "{}", True), ("object", "[]", False), ("enum", '"a"', True), ("enum", '"z"', False), ("date", '"x"', True), ("boolean", "true", True)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "k int, t string, j string")
    got = [r["x"] for r in df.select("k", evaluation.type_valid(F.col("t"), F.col("j"), F.array(F.lit("a"))).alias("x")).orderBy("k").collect()]
    assert got == [w for *_, w in rows]


def test_admission_is_linear_and_keeps_every_request(spark):
    """60,000 requests of one authorization, a fold over which would copy its own result at every step; a request of equal seq is one row, amounts that aren't given are none."""
    import time

    many = spark.range(60_000).selectExpr("'a' authorization_digest", "id seq", "id % 7 input_tokens", "0L output_tokens", "0.0D spend_usd")
    began = time.time()
    rows = ledger.admitted(many, 50_000, 10_000, 9.0).collect()
    assert time.time() - began < 20
    calls = used = 0
    for r in sorted(rows, key=lambda r: r["seq"]):
        ok = calls < 50_000 and used + r["input_tokens"] <= 10_000
        calls, used = calls + ok, used + ok * r["input_tokens"]
        assert r["admitted"] is ok
    assert len(rows) == 60_000
    odd = spark.createDataFrame([("a", 1, 5, None, 0.5), ("a", 1, 4, 0, None), (None, 1, 1, 0, 0.0)], "authorization_digest string, seq bigint, input_tokens bigint, output_tokens bigint, spend_usd double")
    got = ledger.admitted(odd, 9, 8, 9.0)
    assert got.columns == [*odd.columns, "admitted"]
    assert sorted(((r["authorization_digest"] or "", r["input_tokens"], r["admitted"]) for r in got.collect())) == [("", 1, True), ("a", 4, True), ("a", 5, False)]


def test_proposals_of_a_long_text_hold_only_what_they_may_take(spark):
    """Windows of a text whose word occurs everywhere: each proposal takes an occurrence of its own window, and none carries those of the whole text."""
    n, step = 300, 400
    texts = spark.createDataFrame([(1, "ab " * (n * step // 3))], "run_id bigint, full_text string")
    asked = spark.range(n).selectExpr(
        "1L run_id", "id seq", "'t' field_path", "'v' value_canon", "0.5D confidence", "'ab' excerpt", "'x' extractor", "if(id = 7, 2, null) occurrence_hint", f"id * {step} visible_start", f"(id + 1) * {step} visible_end"
    )
    schema = spark.createDataFrame([("t", "string", None, None)], "path string, type string, enum_values array<string>, inference_type string")
    df = grounding.normalized(asked, texts, schema, 1)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    together = next(line for line in plan.split("\n") if "Aggregate" in line and "collect_list" in line)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "visible_spans" in together and "all_spans" not in together
    for r in df.collect():
        first = -(-r["seq"] * step // 3) + (r["seq"] == 7)
        o = r["occurrence"]
        assert (r["start"], r["end"], o["count"], o["selected"]["index"], o["hint_used"]) == (first * 3, first * 3 + 2, n * step // 3, first, r["seq"] == 7)
