"""Page reading, exact marginals against enumeration, and extraction of unseen layouts."""

import html
import itertools
import re
import time

import numpy as np

from tidemark.llm.html_text import N_FEATURES, Forest, Page, extract, main_texts, model, op9_html_extraction

SF = "/root/testdata/sf0.01"
LONG = "One two three four five six seven eight nine ten eleven twelve, thirteen fourteen. "


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    pages = [Page("<div><p>a</p><p>b c<ul><li>d</ul></div>e"), Page(""), Page("x<nav>y</nav>")]
    forest = Forest(pages)
    weights, edges = rng.normal(size=N_FEATURES), rng.normal(size=(2, 2, 2))
    got, joint = forest.marginals(weights, edges)
    own = np.bincount(forest.row, weights[forest.feature], minlength=len(got))
    for a, b in zip(forest.first, forest.first[1:]):
        total, ones, pairs = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for state in itertools.product((0, 1), repeat=b - a):
            score = sum(own[a + i] for i, s in enumerate(state) if s)
            for i in range(1, b - a):
                score += edges[forest.kind[a + i], state[forest.parent[a + i] - a], state[i]]
            total += np.exp(score)
            ones += np.exp(score) * np.array(state)
            for i in range(1, b - a):
                pairs[i, state[forest.parent[a + i] - a], state[i]] += np.exp(score)
        assert np.allclose(got[a:b], ones / total) and np.allclose(joint[a:b], pairs / total)


def test_reading():
    texts = lambda s: [t for t in Page(s).texts if t]
    assert texts('a<b>b</b> &amp;c<br>d<p>e <i>f\n g<p>h<script>var x="</p>";</script>i<!-- j --><style>k</style></p>l') == [
        "ab &c d", "e f g", "h", "i", "l",
    ]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts('<a title="x > y">z</a> 1 < 2 <3') == ["z 1 < 2 <3"]
    assert texts("") == [] and texts("<p>") == [] and texts("</div>a") == ["a"] and texts("<!-- x") == []
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert len(Page("<div>" * 3000 + "x").texts) == 3002


def test_elements_and_tags_without_an_end():
    texts = lambda s: [t for t in Page(s).texts if t]
    article = f"<article><h1>T</h1><p>{LONG}</p><p>Yes.</p></article>"
    for page in (
        f"<html><head><title>x</title><meta name=a>{article}",
        f"<html><head><title>x</title><style>p {{}}</style><body>{article}",
        f"<body>{article[:-10]}<noscript><p>{LONG}</p></article>",
        f"<body>{article[:-10]}<svg><p>{LONG}</p></article>",
    ):
        want = f"T {LONG}Yes." + (f" {LONG}".rstrip() if "noscript" in page or "svg" in page else "")
        assert main_texts([page], *model()) == [want], page
    assert texts("<p>a<script>b<p>c") == ["a"] and texts("<p>a<style>b</styles><p>c") == ["a"]
    assert texts("<p>a<template>b<p>c</p><textarea>d</textarea>e") == ["a", "b", "c", "e"]
    assert texts('<p title="x>a</p><p class="b">c</p>d <a e') == ["a", "c", "d <a e"]
    assert texts('<p title="x>a</p><p>c</p>d') == ["a", "c", "d"]
    assert texts("a<svg x</svg y") == ["a<svg x</svg y"]


def test_long_broken_pages_are_read_once():
    size = 1_000_000
    for part in ("<a ", "<a", "<div></p>", '<a "> "', "<noscript>", "<svg></svg ", "<!x", "<div>", "</p>", '<p class="', "<li><table>", "&lt"):
        page = (part * (size // len(part)))[:size]
        start = time.process_time()
        Page(page + "<p>end.")
        assert time.process_time() - start < 10, part  # a quadratic reader takes hours
    start = time.process_time()
    assert main_texts(["<a " * 333_333], *model()) and time.process_time() - start < 10
    deep = Page("<div>" * 3000 + "x")
    assert max(deep.level) <= 514 and deep.texts[-1] == "x"


def test_unseen_layouts():
    cases = {
        f'<body><nav>{LONG}</nav><div class="adverts">{LONG}</div><article><h1>T</h1><p>{LONG}</p><p>Yes.</p></article>'
        f'<div class="user-comments"><p>{LONG}</p></div><footer>{LONG}</footer>': f"T {LONG}Yes.",
        f'<body><div id="sidebar"><p>{LONG}</p></div><main><p>{LONG}</p><p>{LONG}</p><form><p>{LONG}</p></form></main>'
        f'<div class="cookie-consent">{LONG}</div>': f"{LONG}{LONG}".strip(),
        f'<body><header>{LONG}</header><div class="article-body"><h2>Head</h2><p>{LONG}</p><p>A &lt;b&gt;&nbsp;c</p></div><aside>{LONG}</aside>':
            f"Head {LONG}A <b> c",
    }
    assert main_texts(list(cases), *model()) == list(cases.values())


def test_whole_table(spark):
    rows = op9_html_extraction(spark, SF).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(sources)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", sources[r.page_id], re.S)[1]
        inside = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", "", inside, flags=re.S)
        inside = re.sub(r"</?(p|h1|br|div|ul|li|h2)\b[^>]*>", " ", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", inside)).split())
        assert r.text == want and r.n_chars == len(want), r.page_id


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "<p>" + LONG * 2000, "c"), (2, "<p>" + LONG * 2000, "c")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 0), (1, 0), (2, 2000 * len(LONG) - 1), (2, 2000 * len(LONG) - 1)]
    assert extract(df.where("page_id = 9")).count() == 0
