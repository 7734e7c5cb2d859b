from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearsay.llm import html_text

ARTICLE = "<h1>Title</h1>" + "".join(
    f"<p>Paragraph {i} has some words, a comma, and a <a href='/x'>link</a> in it.</p>"
    for i in range(3)
)
TEXT = "Title " + " ".join(
    f"Paragraph {i} has some words, a comma, and a link in it." for i in range(3)
)
AROUND = [
    "<nav><ul><li><a href=/a>Home page of this site, with words</a></li></ul></nav>",
    "<header><p>Site header, which repeats on every page, and says little.</p></header>",
    "<footer><p>Copyright, terms, and other words that stand on every page.</p></footer>",
    "<aside><p>Related things, that one might read as well, or not.</p></aside>",
    "<div class='cookie-notice'><p>We use cookies, as all do, please accept them now.</p></div>",
    "<div class=\"ad\"><p>Buy this, buy that, it is cheap, and it is new.</p></div>",
    "<div id=comments><p>Great article, I liked it, really, thank you very much!</p></div>",
    "<form><label>Your name, please, and mail address</label><input></form>",
    "<script>var t = '</p><p>not text, at all, never</p>';</script><style>p{margin:0}</style>",
    "<!-- <p>hidden, and no text, though long enough to count</p> -->",
    "<div style='display:none'><p>Hidden words, which no reader sees, at any time.</p></div>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=content>%s</div>", "%s"])
def test_boilerplate_goes(around, wrap):
    body = wrap % ARTICLE
    for page in (f"{around}{body}", f"{body}{around}", f"{around}{body}{around}"):
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>"
        assert html_text.main_text(page.encode()) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("   \n ", ""),
        ("<html></html>", ""),
        ("plain text only", "plain text only"),
        ("<p>a &lt; b &amp; &eacute;&#233;&#xe9; &notaname; x", "a < b & ééé ¬aname; x"),
        ("<p>one\n  two\t&nbsp; three<br>four</p><p>five", "one two three four five"),
        ("<p>1 < 2 and <b>bold</b>er</p>", "1 < 2 and bolder"),
        ("<p><b>open <p>next</b> one", "open next one"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("</div></p>stray</span>", "stray"),
        ("<p>cut <a hre", "cut"),
        ("<p>a</p><script>never closed <p>b</p>", "a"),
        ("<P CLASS='x'>Upper</P>", "Upper"),
        ("<article><header><h1>Kept head</h1></header><p>body</p></article>", "Kept head body"),
    ],
)
def test_small_pages(page, text):
    assert html_text.main_text(page.encode()) == text


def test_layout_words_do_not_drop_the_article():
    page = f"<body><div class='content has-sidebar'>{ARTICLE}</div></body>"
    assert html_text.main_text(page.encode()) == TEXT


@pytest.mark.parametrize("inner", ["<article>%s</article>", "<div>%s</div>", "%s"])
@pytest.mark.parametrize(
    "wrapper",
    ["class='content-sidebar-wrap'", "id='main-no-sidebar'", "class='right-sidebar'",
     "class='social-enabled'", "role=main class='widget'"],
)
def test_names_of_wrappers_do_not_drop_the_article(wrapper, inner):
    side = "<div class='sidebar'><p>Other things, that one might read, or not.</p></div>"
    for inside, after in (("", side), (side, "")):
        page = f"<body><div {wrapper}>{inner % ARTICLE}{inside}</div>{after}</body>"
        assert html_text.main_text(page.encode()) == TEXT


def test_long_comments_beside_an_article_go():
    comment = "<article class='comment-body'><p>Great, I liked it, really, thank you!</p></article>"
    page = f"<body><article>{ARTICLE}</article><div id=comments>{comment * 30}</div></body>"
    assert html_text.main_text(page.encode()) == TEXT


LINE = "<p>Part {} has words, and more words, in quite a long line of the article.</p>"


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("menu", ["", "<div><a href=/m>menu of links only</a></div>"])
def test_all_sections_are_kept(n, menu):
    parts = "".join(
        f"<div class=section><h2>Head {i}</h2><div class=body>{LINE.format(i) * (3 + i % 2)}</div></div>"
        for i in range(n)
    )
    text = html_text.main_text(f"<body><div><div>{parts}{menu}</div></div></body>".encode())
    assert text.count("long line") == sum(3 + i % 2 for i in range(n))
    assert all(f"Head {i}" in text for i in range(n)) and "menu" not in text


def test_small_parts_beside_the_text_are_kept():
    page = (
        f"<body><h1>Name</h1><div>{LINE.format(1) * 4}</div><h2>List</h2><ul><li>one<li>two</ul>"
        f"<p>Short.</p><blockquote>Said so</blockquote><div>{LINE.format(2) * 4}</div>"
        "<ul><li><a href=/a>menu</a></ul></body>"
    )
    text = html_text.main_text(page.encode())
    assert text.startswith("Name Part 1") and "List one two Short. Said so Part 2" in text
    assert "menu" not in text


def test_heading_before_a_text_div_is_kept():
    page = f"<body><div><a href=/>home</a></div><h1>Name</h1><div>{LINE.format(1) * 4}</div></body>"
    assert html_text.main_text(page.encode()).startswith("Name Part 1")


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "the text, deep down, is found" + "</div>" * 20_000
    assert html_text.main_text(deep.encode()) == "the text, deep down, is found"
    long = "<article>" + "<p>some words, again and again, in a row</p>" * 5000 + "</article>"
    text = html_text.main_text(long.encode())
    assert text == " ".join(["some words, again and again, in a row"] * 5000)


def test_siblings_are_kept():
    block = "<p>Words, words, and more words, in quite a long line of the article.</p>"
    page = f"<body><div>{block * 3}</div><div>{block * 2}</div><div><a>menu of links only</a></div>"
    text = html_text.main_text(page.encode())
    assert text.count("Words, words") == 5 and "menu" not in text


def test_pages(spark):
    rows = [(1, "u", "<p>é x</p>"), (2, None, None), (3, "v", ""), (1, "u", "<p>é x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.withColumn("text", F.lit("clash"))
    got = html_text.extract_text(pages)
    assert got.dtypes == [
        ("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint"),
    ]
    assert sorted(tuple(r) for r in got.select("page_id", "text", "n_chars").collect()) == [
        (1, "é x", 3), (1, "é x", 3), (2, "", 0), (3, "", 0),
    ]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_whole_article_of_given_pages(spark):
    """Beside a plain cut of the article element, on every given page."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_text.extract_text(pages, keep=("page_id", "url", "html")).collect()
    assert got
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


PROSE = "This is a sentence of prose, long enough to count, with commas, and more words. " * 3


@pytest.mark.parametrize(
    "body, kept, dropped",
    [
        ("<article><div class='article-header'><h1>Head</h1><p>Lead it.</p></div><p>{}</p></article>", "Head Lead it.", None),
        ("<article><p>{}</p><p class='form-example'>Such a form.</p><p>{}</p></article>", "Such a form.", None),
        ("<article><p class='research-search'>On search.</p><p>{}</p></article>", "On search.", None),
        ("<div class='wrap'><div class='header'><h1>Head line</h1></div><div class='c'><p>{}</p><p>{}</p></div></div>", "Head line", None),
        ("<main><article><p>{}</p><p>{}</p></article><article><p>Short second.</p></article></main>", "Short second.", None),
        ("<article><p>{}</p><div class='entry-notice'>A note of it.</div></article>", "A note of it.", None),
        ("<article><p>{}</p></article><div id='discussion'><p>Zzz {}</p></div>", None, "Zzz"),
        ("<article><p>{}</p><div class='post-comments'><p>Zzz {}</p></div></article>", None, "Zzz"),
        ("<article><p>{}</p><p class='ad'>Zzz buy it.</p></article>", None, "Zzz"),
        ("<main><article><p>{}</p></article><article class='comment'><p>Zzz {}</p></article></main>", None, "Zzz"),
        ("<div class='header'><h1>Zzz site</h1><ul><li><a href=x>n</a></li></ul></div><div id='c'><p>{}</p><p>{}</p></div>", None, "Zzz"),
        ("<article><p>{}</p><div class='ad-slot'>Zzz</div><div class='related-posts'>Zzz two</div></article>", None, "Zzz"),
    ],
)
def test_names_inside_articles(body, kept, dropped):
    text = html_text.main_text(f"<html><body>{body.replace('{}', PROSE)}</body></html>".encode())
    assert "a sentence of prose" in text
    assert kept is None or kept in text
    assert dropped is None or dropped not in text
