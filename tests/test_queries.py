"""Every core query with SQL agrees with it on the small tables."""

import math

import pytest

from gristmill.plans import cases  # noqa: F401  registers its queries
from gristmill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr(tuple(map(one, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def pages(spark):
    return {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_markdown_query_has_every_text(spark):
    """What SQL has no parser for: every run of words of a paragraph is in its page's Markdown, no tag is, and the query gives what the function gives."""
    import re

    from gristmill.functions import markup

    html = pages(spark)
    got = {r["page_id"]: r["markdown"] for r in QUERIES["html_to_markdown"](spark, SF).collect()}
    assert got.keys() == html.keys()
    for k, md in got.items():
        assert md == markup.html_markdown(html[k]["html"])
        body = re.sub(r"(?is)<(nav|header|footer|aside|form|script|style|head)\b.*?</\1>", " ", html[k]["html"])
        flat = " ".join(md.replace("\\", "").split())
        for text in re.findall(r"<p>([^<]{10,}?)</p>", body):
            assert " ".join(text.replace("&amp;", "&").split()) in flat, (k, text[:80])
        assert not re.search(r"</?(p|div|article|script|b)\b", md)


def test_card_query_against_the_function(spark):
    from gristmill.functions import markup

    html = pages(spark)
    for r in QUERIES["card_chunks"](spark, SF).collect():
        want = markup.structural_chunks(html[r["page_id"]]["html"], 400, None)
        assert (r["card_count"], r["structural"], r["n_chunks"], r["length"]) == (want["card_count"], want["structural"], len(want["chunks"]), len(want["full_text"]))
        at = 0
        for text, start, end in want["chunks"]:
            assert start == at and want["full_text"][start:end] == text
            at = end + 2


def test_grounded_extraction_query_against_the_pages(spark):
    """Every word that the pattern finds in a page's prepared text is kept, with a span that has just this text."""
    import re

    from gristmill.functions import markup

    got: dict = {}
    for r in QUERIES["grounded_extraction"](spark, SF).collect():
        s, e = map(int, r["locator"][6:].split("-"))
        got.setdefault(r["run_id"], set()).add((s, e))
    for k, page in pages(spark).items():
        text = markup.structural_chunks(page["html"], 1500, None)["full_text"]
        want = {m.group() for m in re.finditer(r"\b[A-Z][a-z]{5,}\b", text)}
        found = {text[s:e] for s, e in got.get(k, ())}
        # a window's edge may cut a word into one that matches too
        assert want <= found and len(found - want) <= 2 * (len(text) // 1350 + 1) and all(re.fullmatch("[A-Z][a-z]{5,}", x) for x in found), k


def test_entry_without_llm():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys() and ORACLES.keys() <= e.oracle_sql().keys() <= e.queries().keys()


#: Queries over documents that small tables have none of: a text without characters, and one whose only term is beyond the characters of a call.
ODD = ["budgeted_results", "capped_results", "failed_calls", "envelope_lines", "envelope_reasons", "text_extraction", "extracted_bytes"]


@pytest.mark.parametrize("name", ODD)
def test_odd_documents_agree_with_sql(spark, tmp_path, name):
    import duckdb

    rows = [(1, ""), (2, "x " * 20_000 + "the end"), (3, "the first of the texts"), (4, "und " * 4000), (5, "x" * 1500), (6, "x" * 1501)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLES[name])
    assert plain(df.select(*want.columns).collect()) == plain(want.fetchall())
