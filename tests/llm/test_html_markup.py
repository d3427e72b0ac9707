"""Bad and deep markup, and parts of articles, through the main-text extraction."""

import time

import pytest

from tagtide.llm import html_extract as hx

PROSE = "<p>" + "word, another word and more words of prose. " * 8 + "</p>"


@pytest.mark.parametrize("html", [
    "<![foo[x]]>" + PROSE, PROSE + "<![ x", "<![CDATA[x]]>" + PROSE, PROSE + "<!", "<![if x]>" + PROSE + "<![endif]>",
    "<!DOCTYPE [ <!ELEMENT br EMPTY> ]>" + PROSE, "<!--" + PROSE + "-->" + PROSE, "<? x" + PROSE, PROSE + "</", PROSE + "<a b='"])
def test_bad_markup_raises_nothing(html):
    assert "another word and more words of prose." in hx.extract(html)


def test_one_bad_page_does_not_stop_the_others(spark):
    rows = spark.createDataFrame([(1, "u", "<![foo[x]]>" + PROSE), (2, "u", PROSE)], "page_id bigint, url string, html string")
    got = hx.extract_pages(rows).collect()
    assert len(got) == 2 and all(r["n_chars"] > 300 for r in got)


@pytest.mark.parametrize("tags", ["<div>", "<span>", "<a><b></i>", "<header>", "<ul><li>", "<table><tr><td>", "<p><button><span>"])
def test_deep_pages_take_linear_time(tags):
    def seconds(n):
        html = tags * n + PROSE
        t = time.thread_time()
        hx.extract(html)
        return time.thread_time() - t

    assert seconds(40_000) < 8 * seconds(10_000) + 0.5


def test_linked_lists_under_a_heading_stay_in_the_article():
    links = "<ul><li><a href=x>One source of it</a></li><li><a href=y>Two sources</a></li></ul>"
    page = f"<article><section>{PROSE * 4}</section><section><h2>Sources</h2>{links}</section></article>"
    assert "One source of it" in hx.extract(page)
    assert "One source of it" in hx.extract(page.replace("<section><h2>Sources</h2>", "<h2>Sources</h2><section>"))
    assert "One source of it" not in hx.extract(page.replace("Sources", "Related stories"))


def test_short_sentences_after_the_container_stay():
    page = f"<body><div><div>{PROSE * 4}</div><div>SHORT closing line.</div><div>Contact us</div></div></body>"
    assert hx.extract(page).endswith("prose.\n\nSHORT closing line.")
