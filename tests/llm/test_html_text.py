import html
import itertools
import random
import re
import time

import pytest

from marlstone.llm import html_text as H


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 8)
        s = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        cost = lambda side: sum(v if not x else 0 for v, x in zip(s, side) if v > 0) + sum(-v if x else 0 for v, x in zip(s, side) if v < 0) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, E731
        assert cost(H.min_cut(s, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav></header>
<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
<main><article id="post"><header class="entry-header"><h2>Title &amp; more</h2></header>
<p>First   paragraph,\nwith <b>bold</b> and <a href="x">a link</a> &lt;tag&gt; a < b.<p>Short.
<script>var t="</p>";</script><div class="advert"><p>Buy this thing now, it is a very good thing to buy.</p></div>
<ul><li>One item<li>Two items</ul><form><label>Mail</label><input name=q><button>Go</button></form>
<table><tr><td>c1<td>c2</table><p>Caf&eacute; &#8212; end.</p></article></main>
<aside><p>Side text that is long enough to look like a real paragraph of the text.</p></aside>
<section id="comments"><article class="comment"><p>I am a reader and I think this is quite nice to read.</p></article></section>
<footer>&copy; 2020 Site. All rights reserved by the site and by its many authors.</footer></body></html>"""


def test_article():
    assert H.main_text(PAGE).split("\n\n") == ["Title & more", "First paragraph, with bold and a link <tag> a < b.", "Short.", "One item", "Two items", "c1", "c2", "Café — end."]


def test_plain_divs():
    body = "".join(f"<p>This is paragraph {k} of the text, and it is long enough to be told from a menu.</p>" for k in range(4))
    page = f'<body><div class="menu"><a href=a>A</a> <a href=b>B</a></div><div><a href=x>Home</a> | <a href=y>News</a></div><div id=content>{body}</div><div>Copyright 2020 Us</div></body>'
    assert H.main_text(page).count("\n\n") == 3 and "Home" not in H.main_text(page) and "Copyright" not in H.main_text(page)


def test_odd_input(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<<<>>> & &amp &#x110000; </div></p><p class='a"), (5, "u", "<article>" + "<p>word</p>" * 3000), (5, "u", "<p>a<p>b")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got[:3]] == ["", "", ""] and got[4]["text"].count("word") == 3000


def test_pages_table(spark):
    """The tables' own pages hold one article each: its blocks, read by a plain pattern."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert H.main_text(r["html"]) == "\n\n".join(x for x in want if x)


@pytest.mark.parametrize("page", [
    "<a " * 80000, "<![CDATA[" * 20000, "<title>" * 20000, "<!" * 50000, "<div>" * 20000 + "</p>" * 20000, "<ul>" + "<div>" * 3000 + "<li>x</li>" * 5000,
    "<a '\" " * 30000, "<!--" * 30000, "&amp" * 100000, "<p>one two three" * 100000,
])
def test_time_follows_the_length_of_broken_pages(page):
    began = time.time()
    H.main_text(page)
    assert time.time() - began < 10


def test_unclosed_section_costs_no_text():
    assert H.main_text("<p>before it all goes on</p><![CDATA[ x ><p>after it all goes on</p>").count("goes on") == 2
    assert "a < b" in H.main_text("<p>first words <![CDATA[a < b]]> last words</p>")


def test_large_cut_in_time():
    rng = random.Random(4)
    n = 8000
    s = [rng.uniform(-1, 1) for _ in range(n)]
    edges = [(k - 1, k, 0.8) for k in range(1, n)] + [(k - 7, k, 0.7) for k in range(7, n)]
    began = time.time()
    side = H.min_cut(s, edges)
    assert time.time() - began < 20
    cost = lambda side: sum(v for v, x in zip(s, side) if v > 0 and not x) - sum(v for v, x in zip(s, side) if v < 0 and x) + sum(w for a, b, w in edges if side[a] != side[b])
    best = cost(side)
    for k in range(0, n, 37):  # no single change is cheaper
        assert cost(side[:k] + [not side[k]] + side[k + 1 :]) >= best - 1e-6


def test_megabyte_page(spark):
    body = "".join(f"<p>Paragraph {k} is long enough to be told from a menu, is it not.</p>" for k in range(20000))
    page = f"<html><body><nav><a href=x>Home</a></nav><article>{body}</article><footer>End of it</footer></body></html>"
    (r,) = H.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert r["text"].count("\n\n") == 19999 and "Home" not in r["text"] and r["n_chars"] == len(r["text"])
