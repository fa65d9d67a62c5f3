"""URL filters, HTML extraction and connected components."""

import random
import time

import duckdb
import pytest

from lodestar.llm import html_text, queries, urls
from lodestar.llm.graph import connected_components
from tests.llm import brute


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    dice = random.Random(seed)
    edges = [(dice.randrange(60), dice.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


CASES = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://a.com?q", "a.com", "", None, "allow"),
    ("https://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("https://x.net/ES/", "x.net", "/ES/", None, "allow"),
    ("https://notnet/es/", "notnet", "/es/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://É.com/a://b", "É.com", "/a://b", "com/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0], 7) for i, c in enumerate(CASES)] * 2, "page_id bigint, url string, host int")
    rows = urls.url_filter(pages, queries.RULES, spark.createDataFrame([], "a string, b string")).collect()
    assert len(rows) == 2 * len(CASES)
    assert {tuple(r)[:5] for r in rows} == {(i, *c[1:]) for i, c in enumerate(CASES)}
    assert urls.url_filter(pages.limit(0), queries.RULES, spark.createDataFrame([], "a string, b string")).count() == 0


def test_blocks_reach_aliases(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/es/x"), (2, "http://mirror.org/x"), (3, "https://www.mirror.org/x/"), (4, "http://far.org/y"), (5, "http://ok.org/z"), (6, "http://both.org/w")], "page_id bigint, url string")
    links = spark.createDataFrame([("http://mirror.org/x", "http://bad.net/es/x"), ("http://far.org/y", "http://mirror.org/x"), ("http://both.org/w", "http://b.net/fr/1"), ("http://both.org/w", "http://good.com/1"), (None, "http://ok.org/z")], "a string, b string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, queries.RULES, links).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow"}  # nothing links 3 to 2


def test_page_links(spark):
    pages = spark.createDataFrame([("http://a.b/1", "<LINK href='http://c.d/2' rel='canonical'>"), ("http://a.b/3", '<meta http-equiv="refresh" content="0; URL=http://c.d/4">'), ("http://a.b/5", "<link rel=stylesheet href=x.css>"), (None, None)], "url string, html string")
    assert {tuple(r) for r in urls.page_links(pages).collect()} == {("http://a.b/1", "http://c.d/2"), ("http://a.b/3", "http://c.d/4")}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x -->
<article><h1>Head&#233;line</h1><p>First <b>bold</b>&nbsp; words,
 split.<p>Second<br>third &lt;tag&gt;<div class="ad">Buy</div><script>x</script><p>x</p><ul><li>item <a href=q>link</a></li></ul><section class="comments"><p>Reader says hi</p></section></article>
<aside>Side</aside><form><p>Sign up</p><input></form><footer>&copy; Site</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Headéline\nFirst bold words, split.\nSecond\nthird <tag>\nx\nitem link"


def test_page_without_article():
    words = "Plain running text of a page that says enough to count as its main part. " * 3
    page = f"<body><div id=menu><a href=1>one</a></div><div>{words}</div><p>short</p><p>{words}</p><div class=footer>end</div><div><a href=2>far link</a></div></body>"
    assert html_text.main_text(page) == f"{words.strip()}\nshort\n{words.strip()}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text", "just text"), ("<p>a</p><script>never closed", "a"), ("<nav>only menu</nav>", ""), ("<article>x</article></div></p>", "x")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark, data):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 3 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0
    whole = html_text.extract(spark.read.parquet(f"{data}/pages.parquet"))
    assert whole.where("n_chars = 0").count() == 0 and whole.where("text like '%track(%' or text like '%©%'").count() == 0


def test_every_page_beside_a_plain_version(data):
    rows = duckdb.sql(f"SELECT html FROM read_parquet('{data.replace('0.001', '0.1')}/pages.parquet')").fetchall()
    assert len(rows) > 2000
    for (page,) in rows:
        assert html_text.main_text(page) == brute.main_text(page)


def test_the_distribution_decides():
    """Tags shift weights; what does not surge goes, what surges stays, marked or not."""
    words = "Plain running text of a page that says enough to count as its main part. " * 3
    menu = "<ul class=menu><li>one<li>two<li>three<li>four</ul>"
    assert html_text.main_text(f"<article><p>{words}</p></article>{menu}<article><p>tail</p></article>") == words.strip()
    assert html_text.main_text(f"<article><p>a</p><div class=ad>x</div><div class=ad>y</div><div class=ad>z</div><p>{words}</p></article>") == "a\n" + words.strip()
    assert html_text.main_text(f"<div><p>So.</p><p>{words}</p><p>End.</p></div>{menu}<p>far</p>") == f"So.\n{words.strip()}\nEnd."
    assert html_text.main_text(f"<article><p>{words}</p></article><p>{'word ' * 2000}</p>") == f"{words.strip()}\n{('word ' * 2000).strip()}"
    assert html_text.main_text(f"<article><p>{words}</p></article><p>posted today</p>") == words.strip()
    assert html_text.stretches([]) == [] and html_text.stretches([0, 0]) == []
    assert html_text.stretches([0, 0, 5, 0, 0, 0, 70, 0, 10, 0, 0, 0, 7]) == [(4, 9)]


@pytest.mark.parametrize("page", ["<a href=\"x " * 90_000, "<div>x" * 160_000, "<!" * 500_000, "<div class=ad>x" * 60_000, "<div>" * 90_000 + "</ul>" * 90_000, "<script " * 120_000, "<title>" * 140_000, "<p title='a\">x</p>" * 50_000, "&#" + "9" * 900_000])
def test_long_broken_pages(page):
    began = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - began < 30
