"""Main text of pages of several makes."""

import html
import re

import numpy as np
import pytest

from stratalens.llm import html_text, queries

PAGES = [
    ("", ""),
    ("just text &lt; &amp; &eacute;", "just text < & é"),
    ("<nav>menu</nav>", ""),
    ("<p>one<p>two<script>if (a < b) {}</script> three<br>four", "one two three four"),
    ("<article><h1>T</h1><p>a <b>b</b>c</p><aside>no</aside><p>d&nbsp;e</p></article><p>out</p>", "T a bc d e"),
    ("<main><div class='article-body'><p>text</p><form>no<input></form><ul><li>x<li>y</ul></div></main><footer>f</footer>", "text x y"),
    ("<header>site</header><article><header><h1>Head</h1></header><p>body</p><div id='comments'><p>no</p></div></article>", "Head body"),
    ("<div class='cookie-notice'>no</div><div id='c'><p>A long enough paragraph of main text.</p><p>Another one follows it here.</p></div><div class='sideBar'>no</div>", "A long enough paragraph of main text. Another one follows it here."),
    ("<body><div hidden>no</div><div style='display: none'>no</div><p>yes it is text</p></body>", "yes it is text"),
    ("<article><p>x<!-- no --> y</p><style>p{}</style><template>no</template></article", "x y"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
]

WORDS = " ".join(["word"] * 30)
WHOLE = [
    (f"<article><h1>T</h1><div class='body'><p>{WORDS}</p><p>{WORDS}</p></div></article>", f"T {WORDS} {WORDS}"),
    (f"<article><section><p>{WORDS} {WORDS}</p><p>a {WORDS}</p></section><section><p>b {WORDS}</p></section></article>", f"{WORDS} {WORDS} a {WORDS} b {WORDS}"),
    (f"<article><p>before</p><blockquote><p>{WORDS}</p><p>{WORDS}</p></blockquote><p>after</p></article>", f"before {WORDS} {WORDS} after"),
    (f"<main><h1>T</h1><article><p>{WORDS}</p></article><article><p>card</p></article></main>", f"T {WORDS}"),
    (f"<div><h1>T</h1><div><p>{WORDS}</p><p>{WORDS}</p><p><a href='x'>source</a></p><p>{WORDS}</p></div></div>", f"T {WORDS} {WORDS} source {WORDS}"),
]


@pytest.mark.parametrize("page, want", WHOLE)
def test_nothing_of_the_article_is_lost(page, want):
    assert html_text.main_text(page) == want

NAMED = [
    (f"<div class='layout has-sidebar'><article><p>{WORDS}</p></article></div>", WORDS),
    (f"<div class='content-with-nav'><p>{WORDS}</p></div>", WORDS),
    (f"<div id='no-comments'><main><p>{WORDS}</p></main></div>", WORDS),
    (f"<div class='social-wrapper'><h1>T</h1><p>{WORDS}</p></div>", f"T {WORDS}"),
    (f"<div class='promo'><p>{WORDS}</p><p>{WORDS}</p></div><div class='promo'><p>small</p></div>", f"{WORDS} {WORDS}"),
    (f"<article><p class='teaser'>first</p><p>{WORDS}</p><div id='legal-notice-analysis'><p>last</p></div><div class='share-buttons'><p>no</p></div></article>", f"first {WORDS} last"),
    (f"<article><p>{WORDS}</p><div id='comments'><p>{WORDS} {WORDS}</p></div></article>", WORDS),
]


@pytest.mark.parametrize("page, want", NAMED)
def test_names_do_not_hide_articles(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page, want", PAGES)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_smoothing_and_clusters():
    flat = np.ones(7)
    assert np.allclose(html_text.smooth(flat), flat)
    assert html_text.clusters(np.array([0, 0, 0, 90, 80, 90, 0, 0, 0.0])).tolist()[3:6] == [True] * 3
    assert not html_text.clusters(np.array([0, 0, 0, 90, 80, 90, 0, 0, 0.0]))[0]


def test_deep_and_long():
    assert html_text.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000 * 10 - 1


def test_articles_of_the_table(spark, smallest):
    """Against a plain reading of the one article element these pages have."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{smallest}/pages.parquet").collect()}
    got = queries.op4_html_text(spark, smallest).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_frame(spark):
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>a", "t"), (1, "u", "<p>a", "t")], "page_id long, url string, html string, text string")
    assert sorted(str(tuple(r)) for r in html_text.extract(df).collect()) == ["(1, 'u', 'a')", "(1, 'u', 'a')", "(None, None, '')"]
    assert html_text.extract(df.limit(0)).count() == 0


PROSE = " ".join(["prose"] * 60)


def test_clusters_choose_the_region(monkeypatch):
    """Between two articles, and against a card that is an article beside a long plain block; without clusters nothing is found."""
    long, short = f"<article><p>{PROSE}</p><p>{PROSE}</p></article>", "<article><p>tiny</p></article>"
    assert html_text.main_text(short + long) == html_text.main_text(long + short) == f"{PROSE} {PROSE}"
    page = f"<div><div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><article><p>card</p></article></div>"
    assert html_text.main_text(page).startswith(f"T {PROSE} {PROSE}")
    plain = "<div><ul>" + "<li><a href='x'>menu</a></li>" * 8 + f"</ul><div><h2>Head</h2><p>{PROSE}</p><p>{PROSE}</p></div><ul>" + "<li><a href='x'>more</a></li>" * 8 + "</ul></div>"
    assert html_text.main_text(plain) == f"Head {PROSE} {PROSE}"
    monkeypatch.setattr(html_text, "clusters", lambda r: np.zeros(len(r), bool))
    assert html_text.main_text(long) == html_text.main_text(plain) == html_text.main_text(short + long) == ""


@pytest.mark.parametrize("tag, attrs", [("div", ""), ("article", ""), ("div", " class='promo'"), ("span", ""), ("nav", "")])
def test_text_at_every_depth(tag, attrs):
    """5000 elements inside each other, each with text, in time that grows with their number."""
    import time

    page = "<article>" + "".join(f"<{tag}{attrs}>line {i} <p>par</p>" for i in range(5000)) + f"</{tag}>" * 5000 + "</article>"
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 2
