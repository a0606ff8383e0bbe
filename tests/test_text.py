"""Text preparation and chunks against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import chunking


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_html_to_text(spark):
    pages = [
        "<p>One</p><p>Two &amp;amp; <b>three</b></p>", "<script>x<y</script>a<br>b<script>", "a&nbsp;&nbsp;b &lt;i&gt; &hellip; &#39;", "<nav>n</nav><NAV x='1'>m</NAV>  t ",
        "", "plain", "<style>a</style>b<style>c", None, "<head>h</head><header>x</header>y",
    ]
    want = ["One\nTwo &amp; three", "a\nb", "a b <i> … '", "t", "", "plain", "b c", None, "h y"]
    assert column(spark, pages, lambda c: T.html_to_text(c)) == want


def test_adversarial_pages_stay_linear(spark):
    began = time.time()
    column(spark, ["<script>" * 80_000, "<nav>" * 50_000 + "</nav>", "<" * 100_000], lambda c: T.html_to_text(c))
    assert column(spark, ["<script>" * 80_000], T.script_chars) == [640_000]
    assert time.time() - began < 30


def brute_scripts(html):
    low, total, i = html.lower(), 0, 0
    while (a := low.find("<script", i)) >= 0:
        after = low[a + 7 : a + 8]
        if after and (after.isascii() and after.isalnum() or after == "_"):
            i = a + 7
            continue
        close = low.find(">", a)
        end = low.find("</script>", close) if close >= 0 else -1
        if end < 0:
            return total + len(html) - a
        total += end + 9 - a
        i = end + 9
    return total


def test_script_chars_against_a_scanner(spark):
    rng = random.Random(1)
    parts = ["<script", ">", "</script>", "a", " x=1", "<script2>", "<SCRIPT>", "\n", "<", "_"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    assert column(spark, pages, T.script_chars) == [brute_scripts(p) for p in pages]


def test_captions(spark):
    track = (
        "WEBVTT\nKind: captions\n\nNOTE a\nmore\n\n1\n00:01 --> 00:02\nNote this <c>one</c>\n\n00:02 --> 00:03\nNote this one\nStyle &amp; grace\n\n"
        "00:04 --> 00:05\r\nyes\r\n\r\n00:05 --> 00:06\nno\n\n00:06 --> 00:07\nyes\n00:08 --> 00:09\nlast"
    )
    assert column(spark, [track, "", "WEBVTT", None], lambda c: T.vtt_to_text(c)) == ["Note this one\nStyle & grace\nyes\nno\nyes\nlast", "", "", None]


def test_shell(spark):
    shell = "<html><div id='root'></div><script>" + "x" * 2000 + "</script></html>"
    full = "<html><body>" + "word " * 400 + "<script>" + "x" * 9000 + "</script></body></html>"
    df = spark.createDataFrame([(0, shell, False), (1, shell, True), (2, full, False), (3, "", False)], "k int, h string, s boolean")
    rows = df.withColumn("t", T.html_to_text(F.col("h"))).select("k", T.shell_signals(F.col("h"), F.col("t"), F.col("s")).alias("x")).orderBy("k").collect()
    assert [r["x"]["suspected"] for r in rows] == [True, True, False, False]
    assert rows[0]["x"]["warning"].startswith(T.SHELL + ":") and rows[1]["x"]["warning"].startswith(T.SHELL_WITH_STATE + ":") and rows[2]["x"]["warning"] is None


def brute_occurrences(text, excerpt):
    units = lambda s: len(s.encode("utf-16-le")) // 2
    at = [i for i in range(len(text) - len(excerpt) + 1) if excerpt and text.startswith(excerpt, i)]
    return [(k, units(text[:i]), units(text[:i]) + units(excerpt)) for k, i in enumerate(at)]


def test_occurrences_against_brute_force(spark):
    rng = random.Random(2)
    cases = [("aaa", "aa"), ("Marker; Marker; Marker", "Marker"), ("", "a"), ("a", ""), (r"x\E.\E.", r"\E."), ("😀a😀a", "a"), ("😀😀", "😀"), ("abc", "abcd"), ("$1 (a) $1", "$1")]
    cases += [("".join(rng.choice("aab") for _ in range(rng.randrange(12))), "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))) for _ in range(200)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k int, a string, b string")
    got = [[tuple(o) for o in r["x"]] for r in df.select("k", T.occurrences(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()]
    assert got == [brute_occurrences(a, b) for a, b in cases]


def test_nth_occurrence(spark):
    df = spark.createDataFrame([("aaaa", "aa", 1), ("aaaa", "aa", 2), ("aaaa", "aa", 3), ("xay", "a", 1), ("xay", "", 1)], "a string, b string, n int")
    assert [r[0] for r in df.select(T.nth_occurrence(F.col("a"), F.col("b"), F.col("n"))).collect()] == [0, 2, None, 1, None]


def brute_windows(text, size, overlap):
    n = len(text.encode("utf-16-le")) // 2
    out, start, step = [], 0, max(1, size - overlap)
    while n:
        out.append((start, min(start + size, n)))
        if out[-1][1] == n:
            break
        start += step
    return out


@pytest.mark.parametrize("size, overlap", [(100, 20), (10, 0), (7, 7), (5, 9), (1000, 1)])
def test_windows_against_a_loop(spark, size, overlap):
    texts = ["X" * 1000, "", "a" * 100, "b" * 101, "😀b" * 33, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got: dict = {}
    for r in chunking.window_chunks(df, size=size, overlap=overlap, most=None).orderBy("k", "chunk_idx").collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
        if r["k"] != 4:
            assert r["chunk"] == texts[r["k"]][r["start"] : r["end"]]
    assert got == {k: brute_windows(t, size, overlap) for k, t in enumerate(texts) if t}


def test_chunk_cap_and_assembly(spark):
    df = spark.createDataFrame([(1, "X" * 1000)], "k int, text string")
    rows = chunking.window_chunks(df, size=100, overlap=20, most=5).collect()
    assert len(rows) == 5 and {(r["n_chunks"], r["truncated_chunks"]) for r in rows} == {(13, 8)}
    a = df.select(chunking.assembled(F.array(F.lit("ab"), F.lit(""), F.lit("😀"), F.lit("c")), 2).alias("a")).first()["a"]
    assert a["full_text"] == "ab\n\n😀" and [(c["start"], c["end"]) for c in a["chunks"]] == [(0, 2), (4, 6)] and a["truncated"] == 1


def test_repeated_groups(spark):
    rows = [(1, "a", k, "li", 5) for k in range(3)] + [(1, "b", 9 + k, "p", 9) for k in range(3)] + [(2, "a", k, "li", 1) for k in range(2)]
    got = chunking.repeated_groups(spark.createDataFrame(rows, "page_id int, parent string, order int, signature string, text_length int")).collect()
    assert [(r["page_id"], r["signature"], r["n"]) for r in got] == [(1, "p", 3)]


def test_canonical_forms_of_odd_values(spark):
    """Written out by hand what the forms of nested, odd values are; the rows of one file of narrow rows go to many tasks."""
    import json
    import math

    from gristmill.functions import canonical
    from gristmill.plans import cases  # noqa: F401  registers its queries
    from gristmill.plans.queries import QUERIES

    v = {"b": [1, 1.0, -0.0, 1e21, 1e-7, True, None, "ü\n\"\u2028"], "\uff5e": {}, "\U00010400": (), "a": {"z": float("nan"), "y": -math.inf}}
    assert canonical.stable(v) == (
        '["object",[["a",["object",[["y",["number","-Infinity"]],["z",["number","NaN"]]]]],["b",["array",[["number",1],["number",1],["number",0],["number",1e+21],["number",1e-7],["boolean",true],["null"],'
        '["string","ü\\n\\"\u2028"]]]],["\U00010400",["array",[]]],["\uff5e",["object",[]]]]]'
    )
    del v["a"]
    assert canonical.dumps(v) == '{"b":[1,1,0,1e+21,1e-7,true,null,"ü\\n\\"\u2028"],"\U00010400":[],"\uff5e":{}}'
    assert canonical.dumps({"B": 1, "a": 2, "A": 3}, canonical.folded) == '{"a":2,"A":3,"B":1}' and json.loads(canonical.dumps(v))["b"][3] == 1e21
    for name in ("canonical_values", "provider_answers"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
