"""Main texts of pages of many makes."""

import html
import re
import time

import pytest

from railbird.llm import extract
from tests.llm import cases

BODY = " ".join(cases.prose(i, 40) for i in range(3))
PARAGRAPHS = [cases.prose(i, 40) for i in range(3)]
MAIN = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">menu {i}</a></li>' for i in range(9)) + "</ul>"

PAGES = {
    "article": f"<body><nav>{MENU}</nav><article><h1>Title</h1>{MAIN}</article><footer>foot</footer></body>",
    "divs": f'<div id="menu">{MENU}</div><div class="page"><h1>Title</h1><div class="text">{MAIN}</div></div><div class="footer"><p>foot</p></div>',
    "plain menu": f"<table><tr><td>{MENU}</td></tr></table><div><h1>Title</h1>{MAIN}</div>",
    "unclosed": f"<article><h1>Title<p>{'<p>'.join(PARAGRAPHS)}",
    "comments": f'<main><h1>Title</h1>{MAIN}</main><section id="comments"><h2>Comments</h2><p>{cases.prose(50, 90)}</p></section>',
    "inside": f'<article><h1>Title</h1><div class="ad-slot"><p>Buy {cases.prose(51, 30)}</p></div>{MAIN}'
    f'<aside>more</aside><form><input><p>sign up</p></form><div class="comments"><p>{cases.prose(52, 60)}</p></div></article>',
    "raw": f'<script>var a = "<p>x</p>";</script><style>p{{}}</style><!-- <p>no</p> --><article><h1>Title</h1>{MAIN}</article><script>b',
    "hidden": f'<article><h1>Title</h1><p hidden>no</p><div style="display: none"><p>no</p></div>{MAIN}</article>',
    "cookie": f'<div class="cookie-notice"><p>We use {cases.prose(53, 80)}</p></div><div role="main"><h1>Title</h1>{MAIN}</div>',
}


@pytest.mark.parametrize("name", PAGES)
def test_article_without_the_rest(name):
    assert extract.main_text(PAGES[name]) == "Title " + " ".join(PARAGRAPHS)


BESIDE = {
    "lead": f"<p>{PARAGRAPHS[0]}</p>",
    "short": "<p>Short.</p>",
    "quote": f"<blockquote>{PARAGRAPHS[1]}</blockquote>",
    "quoted paragraph": "<blockquote><p>Said one.</p></blockquote>",
    "pre": "<pre>a = 1</pre>",
    "h2": "<h2>Part two</h2>",
    "list": "<ul><li>first</li><li>second</li></ul>",
    "div": f"<div>{PARAGRAPHS[2]}</div>",
}


@pytest.mark.parametrize("name", BESIDE)
@pytest.mark.parametrize("wrap", ['<div class="post">{}</div>', "{}"])
def test_blocks_beside_a_denser_one_are_kept(name, wrap):
    block = BESIDE[name]
    text = " ".join(re.sub("<[^>]*>", " ", block).split())
    body = f'<div class="body">{MAIN}</div>'
    menu = f"<div>{MENU}</div>"
    assert extract.main_text(menu + wrap.format(block + body)) == " ".join([text, *PARAGRAPHS])
    assert extract.main_text(menu + wrap.format(body + block)) == " ".join([*PARAGRAPHS, text])


WRAPPERS = [
    'id=content class="content-with-sidebar"', 'class="has-sidebar"', 'class="post comments-open"', 'class="category-social"',
    'class="legal-news"', 'id="modal-root" class="page"', 'class="widget"',
]


@pytest.mark.parametrize("attrs", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}"])
def test_wrappers_of_the_article_are_not_dropped(attrs, inner):
    aside = f'<div class="sidebar-right"><p>{cases.prose(54, 30)}</p></div>'
    page = f"<body><nav>{MENU}</nav><div {attrs}><h1>Title</h1>{inner.format(MAIN)}{aside}</div></body>"
    text = " ".join(PARAGRAPHS)
    assert extract.main_text(page) in (text, f"Title {text}")
    inside = f"<article><h1>Title</h1><div {attrs}>{MAIN}</div></article>"
    assert extract.main_text(inside) == f"Title {text}"


def test_long_comments_do_not_replace_the_article():
    comments = "".join(f'<article class="comment"><p>{cases.prose(60 + i, 90)}</p></article>' for i in range(9))
    page = f'<article><h1>Title</h1>{MAIN}</article><div id="comments"><p>{cases.prose(55, 400)}</p></div>'
    assert extract.main_text(page) == "Title " + " ".join(PARAGRAPHS)
    page = f'<article><h1>Title</h1>{MAIN}</article><div class="related-posts">{comments[: len(comments) // 9]}</div>'
    assert extract.main_text(page) == "Title " + " ".join(PARAGRAPHS)


def test_lists_of_links_beside_the_content_go():
    page = f'<div class="post">{MENU}<div class="body">{MAIN}</div><p><a href="/">all of it a link</a></p></div>'
    assert extract.main_text(page) == " ".join(PARAGRAPHS)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a<b>b</b>c<br>d</p><p>e\n\t f</p>", "abc d e f"),
        ("<article><p>1 &lt; 2 &amp;amp; &eacute;&#233;&nbsp;x</p></article>", "1 < 2 &amp; éé x"),
        ("<nav>only a menu</nav>", ""),
        ("<" * 2000, "<" * 2000),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("</p></div>stray", "stray"),
    ],
)
def test_small_sources(source, text):
    assert extract.main_text(source) == text


def test_density_falls_with_links():
    plain, linked = extract.composite(500, 0, 5, 0, 2000, 400), extract.composite(500, 450, 5, 5, 2000, 400)
    assert plain > linked > 0 and extract.composite(0, 0, 3, 0, 0, 0) == 0


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract.main_texts(pages).collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        spaced = re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))
        assert r["text"] == " ".join(html.unescape(spaced).split()) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (2, "u", "", 5), (None, "u", PAGES["article"], 5), (4, "u", "x" * 200_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted([(r["page_id"], r["n_chars"]) for r in extract.main_texts(pages).collect()], key=repr)
    assert got == sorted([(1, 0), (1, 0), (2, 0), (4, 200_000), (None, len("Title " + " ".join(PARAGRAPHS)))], key=repr)
    assert extract.main_texts(pages.where("page_id > 9")).count() == 0


@pytest.mark.parametrize("shape", ["<a ", '<b" ', "<div>", "<span>x", "<p>x", "<li><a href=x>y", "<!-- ", "<div>x</b>", "<script>", "</div>", "<article>x"])
def test_a_megabyte_of_unclosed_markup(shape):
    page = "<body><div><p>" + "A sentence of the article. " * 20 + "</p></div>" + shape * ((1 << 20) // len(shape))
    began = time.perf_counter()
    text = extract.main_text(page)
    # a tenth of it would take a hundredth, were it quadratic
    assert time.perf_counter() - began < 20 and isinstance(text, str)
    small = time.perf_counter()
    extract.main_text(page[: len(page) // 8])
    assert time.perf_counter() - began < 40 * (time.perf_counter() - small) + 5
