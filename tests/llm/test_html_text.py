import html as entities
import re

import duckdb
from specloom.llm import html_text

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Title &amp; more</title><style>p{margin:0}</style>
<script>var t="</p>";track(1);</script></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy now.</div>
<%s><h1>The  headline</h1><p><b>First&nbsp;block &lt;one&gt;<br>goes
 on.<br><p>Second block with a <a href="/x">link</a> in it, and enough words to count as text.
<aside>Read this too</aside><div class="share">Share it</div><ul><li>Point one<li>Point two</ul>
<blockquote>Quoted words of someone who knew.</blockquote><form><label>Mail</label><input></form></%s>
<section id="comments"><h2>Comments</h2><p>I liked it a lot, thank you for the long and fine article.</p></section>
<div role="complementary"><p>Sidebar text</p></div><footer>&copy; site</footer></body></html>"""
WANT = "The headline\n\nFirst block <one> goes on.\n\nSecond block with a link in it, and enough words to count as text.\n\nPoint one\n\nPoint two\n\nQuoted words of someone who knew."


def test_article_without_furniture():
    assert html_text.main_text(PAGE % ("article", "article")) == WANT
    assert html_text.main_text(PAGE % ("main", "main")) == WANT


def test_pages_without_article():
    text = html_text.main_text(PAGE % ("div", "div"))
    assert text.startswith("The headline\n\nFirst block <one> goes on.\n\nSecond block")
    assert "cookies" not in text and "liked" not in text and "Site" not in text and "©" not in text


def test_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> </p>") == ""
    assert html_text.main_text("no tags at all &eacute;") == "no tags at all é"
    assert html_text.main_text("<article><p>open &#x41;&#66; <i>ended") == "open AB ended"
    assert html_text.main_text("<article>" + "<p>some words here</p>" * 20000 + "</article>").count("\n\n") == 19999


def test_given_pages_against_plain_reading():
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
        blocks = [entities.unescape(re.sub(r"(?s)<[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
        blocks = [" ".join(b.split()) for b in blocks]
        assert html_text.main_text(page) == "\n\n".join(b for b in blocks if b)


def test_every_row_of_a_table(spark):
    rows = [(1, "u", PAGE % ("article", "article"), "clash"), (1, "u", PAGE % ("article", "article"), "clash"), (None, None, None, None), (2, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extracted(df).collect())
    assert got == sorted([("1", "u", WANT, len(WANT))] * 2 + [("None", "None", "", 0), ("2", "v", "", 0)])
    assert html_text.extracted(df.limit(0)).count() == 0


def test_marks_drop_no_article():
    body = "<h1>A headline</h1><p>The first block of the article has words enough.</p><p>Yes.</p><p>The second one has them as well, as it should.</p><p>No.</p>"
    want = "A headline\n\nThe first block of the article has words enough.\n\nYes.\n\nThe second one has them as well, as it should.\n\nNo."
    for page in (
        f'<body><div class="site-header">Site</div><article><div class="entry-header"><h1>A headline</h1></div>{body.split("</h1>")[1]}</article></body>',
        f'<body><article class="post"><header class="article-header"><h1>A headline</h1></header>{body.split("</h1>")[1]}</article><div class="comments-area"><article class="comment"><p>Nice, I liked this very much indeed.</p></article></div></body>',
        f'<body><div class="ad-free content">{body}</div></body>',
        f'<body><div class="related-work">{body}</div><div class="ad-slot">Buy</div></body>',
        f'<body><div id="notes-on-legal-history">{body}</div></body>',
        f'<body><div class="layout has-sidebar"><article>{body}</article><div class="sidebar">Read on</div></div></body>',
        f'<body class="page-with-comments no-footer"><div class="sidebar-wrap"><article>{body}</article></div><div class="siteFooter">All rights</div></body>',
        f'<body><div class="content-wrapper banner"><div>{body}</div></div><div class="cookie-notice">We use cookies.</div></body>',
    ):
        assert html_text.main_text(page) == want, page


def test_formulas_and_short_blocks_stay():
    page = "<article><p>Mass and energy: <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> holds.</p></article>"
    assert html_text.main_text(page) == "Mass and energy: E=mc2 holds."
    assert html_text.main_text("<div><p>Yes.</p><p>No.</p><p>A longer block of words that is the text of the page.</p><p>No.</p><p>End.</p></div>").split("\n\n")[0::4] == ["Yes.", "End."]
