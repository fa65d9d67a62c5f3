"""Links and verdicts of addresses, and main texts, where a page is not as plain as the tables' pages."""

import duckdb
import pytest

from lodestar.llm import html_text, oracles, queries, urls
from tests.llm import brute


@pytest.mark.parametrize(
    ("target", "address"),
    [("/es/x", "http://a.net/es/x"), ("//b.net/x", "http://b.net/x"), ("x?y=//z", "http://a.net/p/x?y=//z"), ("../x", "http://a.net/x"), ("./x/../../y/.", "http://a.net/y/"), ("../../..", "http://a.net/"), ("?r", "http://a.net/p/q?r"), ("https://c.d", "https://c.d"), ("mailto:a@b", None)],
)
def test_addresses_on_a_page(spark, target, address):
    html = f"<link rel=canonical href='{target}'>"
    pages = spark.createDataFrame([("http://a.net/p/q?s=/t#u", html), ("no scheme", "<link rel=canonical href='/x'>")], "url string, html string")
    assert [r["target"] for r in urls.page_links(pages).collect()] == ([address] if address else [])
    bare = spark.createDataFrame([("http://a.net", "<link rel=canonical href=x>")], "url string, html string")
    assert [r["target"] for r in urls.page_links(bare).collect()] == ["http://a.net/x"]


def test_all_links_of_a_page(spark):
    html = "<link rel=canonical><link rel=canonical href=/1><link href=//b.net/2 rel=canonical><meta http-equiv=refresh content='3'><meta http-equiv=refresh content='0; url=/3'>"
    pages = spark.createDataFrame([("https://a.net/", html)], "url string, html string")
    assert sorted(r["target"] for r in urls.page_links(pages).collect()) == ["https://a.net/1", "https://a.net/3", "https://b.net/2"]


def test_links_are_judged_by_their_address(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.org/1", "<link rel=canonical href='https://x.net/es/'>"),  # block of /es/, lost without the slash
            (2, "http://a.org/2", "<link rel=canonical href='https://www.example.com/en/a'>"),  # allow of www.example.com
            (3, "http://a.org/3", "<link rel=canonical href='//y.net/fr/z'><link rel=canonical href='/4'>"),
            (4, "http://a.org/4", ""),
            (5, "http://a.org/5", "<meta http-equiv=refresh content='0; url=1'>"),
            (6, "http://z.net/es", "<link rel=canonical href='http://z.net/es/'>"),
            (7, "http://a.org/7", None),
        ],
        "page_id bigint, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, queries.RULES, urls.page_links(pages)).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


@pytest.mark.parametrize(
    ("html", "targets"),
    [
        ("<link rel='canonical' href='/a?x=1&amp;y=2'>", ["http://a.net/a?x=1&y=2"]),
        ("<link rel='alternate CANONICAL' href=/b>", ["http://a.net/b"]),
        ("<link rel=canonicals href=/b><link rel=x title='rel=canonical' href=/b>", []),
        ("<link data-href=/wrong rel=canonical href=/c>", ["http://a.net/c"]),
        ("<link title='href=/wrong >' rel=canonical href=/d>", ["http://a.net/d"]),
        ("<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script><title><link rel=canonical href=/no></title>", []),
        ("<!-- never closed <link rel=canonical href=/no>", []),
        ("<link rel=canonical href='&#47;e&#x2F;&#233;&#;&unknown;'>", ["http://a.net/e/é&#;&unknown;"]),
        ("<meta http-equiv='Refresh' content='5;URL=&quot;/f&quot;'><meta http-equiv=refresh content=5>", ["http://a.net/f"]),
        ("<link rel=canonical href=/open", []),
        ("<linkrel=canonical href=/no><p>link rel=canonical href=/no</p>", []),
    ],
)
def test_tags_as_a_browser_reads_them(spark, html, targets):
    pages = spark.createDataFrame([("http://a.net/p", html.replace("&#;", "&-;"))], "url string, html string")
    assert [r["target"].replace("&-;", "&#;") for r in urls.page_links(pages).collect()] == targets


def test_only_links_make_aliases(spark):
    same = ["http://m.org/x", "HTTP://M.ORG:80/x#part"]
    others = ["https://m.org/x", "http://www.m.org/x", "http://m.org/x/", "http://m.org/x?ref=1", "http://m.org/x?ref=2", "http://org/x", "http://m.org/X", "http://m.org:8080/x"]
    pages = spark.createDataFrame(list(enumerate(same + others)), "page_id bigint, url string")
    links = spark.createDataFrame([("http://m.org/x", "http://bad.net/es/x")], "a string, b string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, queries.RULES, links).collect()}
    assert got == {i: "block" if i < 2 else "allow" for i in range(len(same + others))}
    bare = spark.createDataFrame([(1, "http://m.org"), (2, "http://m.org/"), (3, "http://m.org?"), (4, "//m.org")], "page_id bigint, url string")
    assert {r["page_id"]: r["component"] for r in urls.url_filter(bare, queries.RULES, links.limit(0)).collect()} == {1: "http://m.org/", 2: "http://m.org/", 3: "http://m.org/?", 4: None}


def test_many_rules_are_joined(spark, monkeypatch):
    hosts = ["com", "example.com", "www.example.com", "net", "x.net", "a.b.org"]
    rules = [urls.Rule(("allow", "block")[(i + j) % 2], h, p) for i, h in enumerate(hosts) for j, p in enumerate(["/", "/en/", "/en/a"])] + [urls.Rule("block", "net", "/"), urls.Rule("allow", "net", "/")]
    pages = spark.createDataFrame([(i, f"http://{s}{h}{p}", 1) for i, (s, h, p) in enumerate((s, h, p) for s in ("", "q.", "z") for h in [*hosts, "org"] for p in ("", "/", "/en/", "/en/ab", "/fr"))] + [(999, None, 1)], "page_id bigint, url string, rule int")
    links = spark.createDataFrame([("http://org/fr", "http://com/en/"), ("http://zorg/", "http://x.net/")], "a string, b string")
    want = sorted(map(tuple, urls.url_filter(pages, rules, links).collect()), key=repr)
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    assert sorted(map(tuple, urls.url_filter(pages, rules, links).collect()), key=repr) == want


def test_sql_reads_links_alike(spark, tmp_path):
    """The SQL beside the query on pages full of links."""
    htmls = [
        "<link rel=canonical href='https://x.net/es/'>", "<link rel='alternate canonical' data-href=/no href='/4?a=1&amp;b=&#50;'>", "<!-- <link rel=canonical href=//y.net/fr/z> --><link rel=canonical href='/4'>", "<meta http-equiv=refresh content='0; url=../1'>",
        "<META HTTP-EQUIV='Refresh' CONTENT='3;URL=\"//y.net/fr/z\"'><link rel=canonical href=https://www.example.com/en/a>", "<script><link rel=canonical href=https://x.net/es/></script>", "<link rel=canonical href='./p/../../q/.'><link rel=canonical href='?z'><link rel=canonical href='#t'>", None, "", "<link rel=canonical href=mailto:a@b><link href=x>",
    ]
    pages = [(i, f"http://a.org/d/{i}", h) for i, h in enumerate(htmls)] + [(50, "http://a.org/d/4?a=1&b=2", ""), (51, "http://a.org/4?a=1&b=2", ""), (52, "https://x.net/es/", None), (53, "http://a.org/1", None), (54, "no scheme", "<link rel=canonical href=/x>"), (55, None, "<link rel=canonical href=http://x.net/es/>"), (56, "HTTP://A.ORG:80/1#x", "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cursor = con.execute(oracles.URLS)
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = sorted((tuple(r[n] for n in names) for r in queries.op5_url_filter(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    assert {r[names.index("page_id")] for r in got if r[names.index("verdict")] == "block"} > {52}


WORDS = "Plain running text of a page that says enough to count as its main part. " * 3


@pytest.mark.parametrize("tag", ["div class='overflow-hidden'", "section style='overflow:hidden'", "main data-hidden=1", "article class=hidden-print", "div class=has-sidebar", "div title='hidden display: none'", "article class='comments-open'", "main id=comments"])
def test_a_holder_keeps_its_text(tag):
    name = tag.split()[0]
    assert html_text.main_text(f"<body><{tag}><p>{WORDS}</p></{name}><footer>end</footer></body>") == WORDS.strip()


@pytest.mark.parametrize("tag", ["div class='comments-open'", "section id=sidebar"])
def test_a_mark_around_the_article(tag):
    page = f"<body><{tag}><p>menu</p><article><p>{WORDS}</p><div class=comments><article class=comment><p>{WORDS * 2}</p></article></div></article></{tag.split()[0]}></body>"
    assert html_text.main_text(page) == WORDS.strip()


@pytest.mark.parametrize("tag", ["div hidden", "div HIDDEN=''", "div style='color:red; display: none'", "div aria-hidden=true", "div class='x comments'", "div id=cookie-notice", "div class=site-footer"])
def test_boilerplate_is_still_dropped(tag):
    assert html_text.main_text(f"<body><p>{WORDS}</p><{tag}><p>{WORDS}x</p></div></body>") == WORDS.strip()
    readers = f"<section class=comments><article><p>{WORDS}</p></article></section>"
    assert html_text.main_text(f"<div>{WORDS * 2}</div>{readers}") == (WORDS * 2).strip()


REMARK = "I think that this is a very long remark of a reader, who goes on and on about what the page says. " * 4


def test_what_stands_beside_a_marked_article_is_not_part_of_it():
    article = f"<article><h1>Head</h1><p>{WORDS}</p></article>"
    want = f"Head\n{WORDS.strip()}"
    for page in (f"{article}<div>{REMARK}</div>", f"<div>{REMARK}</div>{article}", f"{article}<div>{REMARK}</div><div>{REMARK}</div><footer>x</footer>", f"<main>{article}</main><p>{REMARK}</p>"):
        assert html_text.main_text(f"<body>{page}</body>") == want == brute.main_text(f"<body>{page}</body>")


@pytest.mark.parametrize("name", ["related-work", "notification-theory", "menu-engineering", "banner_years", "comments-open", "social-history"])
def test_a_subject_is_no_part_of_the_page(name):
    inside = f"<article><p>{WORDS}</p><section class='{name}'><p>{WORDS}</p></section></article><div>{REMARK}</div>"
    assert html_text.main_text(inside) == f"{WORDS.strip()}\n{WORDS.strip()}" == brute.main_text(inside)
    alone = f"<body><div class='{name}'><p>{WORDS}</p></div><div class=comments><p>{REMARK}</p></div></body>"
    assert html_text.main_text(alone) == WORDS.strip() == brute.main_text(alone)


@pytest.mark.parametrize("name", ["related-posts", "cookie-notice", "ad-728x90", "comment-list", "share_box", "sidebar-wrapper", "site-footer", "nav-links"])
def test_a_part_of_the_page_is_dropped(name):
    page = f"<article><p>{WORDS}</p><div class='{name}'><p>{WORDS}</p></div></article>"
    assert html_text.main_text(page) == WORDS.strip() == brute.main_text(page)
