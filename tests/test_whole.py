"""Registered queries read the whole of long pages."""

from gristmill.plans.queries import QUERIES


def pages(spark, folder, htmls):
    rows = [(k, f"https://a.example/{k}", h) for k, h in enumerate(htmls)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def card_page(number, words, end=""):
    return "<body><div>" + "".join(f'<div class="card"><p>{"lorem " * words}{end if k == number - 1 else ""}</p></div>' for k in range(number)) + "</div></body>"


def test_grounded_extraction_reads_every_chunk(spark, tmp_path):
    prose = f"<body><p>Opening {'lorem ' * 2000} Closing</p></body>"
    long_card = card_page(3, 6000, "Closing")  # a card is never split: over 32,000 characters in a chunk
    sf = pages(spark, tmp_path, [prose, card_page(60, 200, "Closing"), long_card])
    got = QUERIES["grounded_extraction"](spark, sf).collect()
    assert sorted((r["run_id"], r["value_json"]) for r in got) == [(0, '"Closing"'), (0, '"Opening"'), (1, '"Closing"'), (2, '"Closing"')]


def test_card_chunks_has_every_batch(spark, tmp_path):
    sf = pages(spark, tmp_path, [card_page(60, 60)])
    got = QUERIES["card_chunks"](spark, sf).first()
    assert (got["card_count"], got["n_chunks"]) == (60, 60) and got["length"] == 60 * 359 + 59 * 2
