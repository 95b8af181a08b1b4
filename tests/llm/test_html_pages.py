"""HTML extraction: pages without marks, names that mislead, and odd rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import html_extract, queries

DATA = "/root/testdata/sf0.01"
PROSE = " ".join("Some words of prose stand here, in a plain sentence of the text." for _ in range(12))
BODY = f"<h1>Title here</h1><p>{PROSE}</p><p>{PROSE}</p>"
WANT = f"Title here\n{PROSE}\n{PROSE}"
NAV = "<nav><ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(6)) + "</ul></nav>"
MENU = '<div class="m"><ul>' + "".join(f"<li><a href=/{i}>Menu entry</a></li>" for i in range(30)) + "</ul></div>"


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.train(spark.read.parquet(f"{DATA}/pages.parquet"))


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        (f'<article class="post comments-open">{BODY}</article>', WANT),
        (f'<div class="page has-sidebar"><div>{BODY}</div><div class="sidebar">Other things</div></div>', WANT),
        (f'<form id="aspnetForm"><div>{BODY}</div></form>', WANT),
        (f'<div id="form-section">{BODY}</div>', WANT),
        (f'<article>{BODY}<h2 id="related-work">Related work</h2><p>{PROSE}</p></article>', f"{WANT}\nRelated work\n{PROSE}"),
        (f'<article>{BODY}<section id="notice-period"><p>{PROSE}</p></section></article>', f"{WANT}\n{PROSE}"),
        (f"{MENU}<div class=x>{BODY}</div>", WANT),
        (f'<div class=content>{BODY}<div class="cookie-notice">We use cookies</div><div class="comments"><p>{PROSE}</p></div><div class="ad-box">buy</div></div>', WANT),
        (f'<article>{BODY}<div class="share-buttons">Share</div><section id="comments"><p>{PROSE}</p></section><div class="newsletter-form">Mail</div></article>', WANT),
        (f"<div id=c>{BODY}<ul><li>one item<li>two items</ul><p>Last.</p></div>", f"{WANT}\none item\ntwo items\nLast."),
    ],
)
def test_names_are_evidence(weights, inner, want):
    assert html_extract.extract(f"<html><head><title>T</title></head><body>{NAV}{inner}<footer>&copy; 2020 words</footer></body></html>", weights) == want


def truth(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_without_their_mark(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = html_extract.train(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r.page_id: r.text for r in html_extract.main_text(bare, weights).collect()}
    for r in pages.collect():
        assert got[r.page_id] == truth(r.html)


def test_whole_query(spark):
    got = {r.page_id: r for r in queries.op10_html(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        assert got[r.page_id].text == truth(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark, weights):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (3, "u", "<p>a b</p>", "x", 1), (3, "u", "<p>a b</p>", "x", 1), (None, "u", long, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.main_text(pages, weights)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 5 * 400_000 - 1), (1, 0), (2, 0), (3, 3), (3, 3)]
    none = pages.limit(0)
    assert html_extract.main_text(none, html_extract.train(none)).count() == 0
    assert html_extract.extract(f"<p>{PROSE}</p>", html_extract.learn([])) == PROSE
