"""Time and odd rows of the extraction of pages."""

import time

import pytest

from lodestone.llm import html_text

SHAPES = {
    "unclosed quote": lambda n: "<b " * n + "'",
    "ends without starts": lambda n: "<div>" * n + "</x>" * n,
    "blocks in deep inline": lambda n: "<b>" * n + "<h1>x</h1>" * n,
    "breaks in deep inline": lambda n: "<b>" * n + "<br>text" * n,
    "paragraphs in deep inline": lambda n: "<b>" * n + "<p>some text, here</p>" * n,
    "quotes in quotes": lambda n: "<a \" > ' <b ' \"" * n + "'",
    "nested items": lambda n: "<li><p>" * n + "<h1>x</h1>" * n,
    "options in items": lambda n: "<li><p>" * n + "<option>" * n,
    "comments": lambda n: "<!--" * n,
    "cells": lambda n: "<td><tr>" * n,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_time_follows_the_length(shape):
    """Four times the page takes far less than sixteen times the time."""
    took = []
    for n in (4000, 16000):
        page = SHAPES[shape](n)
        best = min(_timed(page) for _ in range(2))
        took.append(best)
    assert took[1] < 9 * took[0] + 0.2, took


def _timed(page):
    t = time.perf_counter()
    html_text.extract(page)
    return time.perf_counter() - t


def test_a_quote_that_nothing_closes_is_a_character():
    assert html_text.extract("<article><p class=\"x>One sentence, long enough to count here.</p><p>And it's two.</p></article>") == "One sentence, long enough to count here. And it's two."
    assert html_text.extract("<p>a &#" + "9" * 6000 + "; b &#0000000000065; &#x41; &#;</p>") == "a � b A A &#;"


def test_table_of_pages(spark):
    """Null and empty pages, repeated rows, clashing and extra columns, an empty table, a page cut off anywhere."""
    page = "<html><body><nav>Menu</nav><article><p>First,  paragraph\n here &amp; there.</p><p>Second one.</p></article></body></html>"
    rows = [(1, "u", None, 7, "t"), (2, None, "", 7, "t"), (3, "v", page, 7, "t"), (3, "v", page, 7, "t"), (None, "w", page, 7, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, TEXT string")
    got = html_text.texts(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    body = "First, paragraph here & there. Second one."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, body, len(body)), (1, "", 0), (2, "", 0), (3, body, len(body)), (3, body, len(body))]
    assert html_text.texts(pages.limit(0)).count() == 0
    for cut in range(len(page)):
        html_text.extract(page[:cut])
    assert html_text.extract(page[: page.index("</p><p>Second")]) == "First, paragraph here & there."


def test_query_reads_every_page(spark):
    """The query against the plain function over all pages of the smallest table."""
    where = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.url, html_text.extract(r.html)) for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    got = html_text.op4_html_extraction(spark, where).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == pages and len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
