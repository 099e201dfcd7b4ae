"""Listing readers: each parser's own rules, over invented pages."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import dates
from skeinwork.sources import listings
from skeinwork.sources.listings import PARSERS, excerpt_of, links_of
from skeinwork.sources.registry import UnsupportedSource

BASE = "https://press.example.org/news/"


def urls(body, parser, path=r"^/a/[^/]+$", **more):
    return [e["url"].removeprefix("https://press.example.org") for e in links_of(body, BASE, PARSERS[parser], path, **more)]


def test_links_by_first_sight():
    body = '<a href="/a/1">x</a><a href="/b/2">y</a><A HREF="../a/3">z</a><a href="/a/1"><a name="q"><a href="/a/page?x=1#t">'
    assert urls(body, "links") == ["/a/1", "/a/3", "/a/page?x=1#t"] and urls(body, "links", never="page") == ["/a/1", "/a/3"]
    assert urls("<!-- <a href='/a/7'> <div <p", "links") == ["/a/7"] and urls("<!-- <a href='/a/7'> <div <p", "excerpts") == []  # markup beyond repair
    assert urls("", "links") == [] and urls('<a href="http://[bad">x</a>', "links") == []


def test_only_links_in_headings():
    body = '<a href="/a/1">x</a><h2><span><a href="/a/2">y</a></h2><p><a href="/a/3"></p><h2>t</h2><a href="/a/4"><h2><b></h3><a href="/a/5">'
    assert urls(body, "headings") == ["/a/2", "/a/5"]


def test_entries_have_titles_and_dates():
    body = """<p>1.1.2001</p><a href="/a/x1">The <b>first</b></a><span class="news-Date">3. März 2024</span> Context one.
        <script>2.2.2002</script><a href="/b/1">other</a><a href="/a/x2">Second</a><div id="date"><i>4.5.2024</i></div><p>Pressemitteilung Nr. 7 vom 4. Mai 2024 Die Zahl stieg.</p><a href="/a/a/x3">Third</a>"""
    a, b, c = links_of(body, BASE, PARSERS["links_with_dates"], r"^/a/x\d$", prefix="/a/")
    assert (a["title"], a["date"], a["context"]) == ("The first", "3. März 2024", "Context one. other")
    assert (b["title"], b["date"]) == ("Second", "4.5.2024") and b["context"].endswith("Die Zahl stieg.")
    assert c["url"].endswith("/a/x3") and (c["title"], c["date"], c["context"]) == ("Third", "", "")


def test_excerpts():
    body = "<p>One.</p><p>Subscribe now</p><p class='x'><b>Two</b> &amp; more.</p><p>One.</p><p>Three.</p><p>Four.</p>"
    assert excerpt_of("About. One.", body) == "About. One. Two & more. Three."
    assert excerpt_of(None, body) == "One. Two & more. Three." and excerpt_of(None, "") is None
    long = "word " * 300
    assert excerpt_of(None, f"<p>{long}</p>") == ("word " * 180).strip() and excerpt_of("x", f"<p>{long}</p>") == "x"


def read(spark, parser, pages, articles, **more):
    rows = [(f"l{i}", parser, [u for u, _ in ps], "^/a/", *more.values()) for i, ps in enumerate(pages)]
    names = spark.createDataFrame(rows, "listing string, parser string, urls array<string>, path string" + "".join(f", {k} {'int' if k == 'most' else 'string'}" for k in more))
    bodies = spark.createDataFrame([p for ps in pages for p in ps if p[1] is not None] + [(f"https://x.org/a/{k}", v) for k, v in articles.items()], "url string, body string")
    got = {r["listing"]: r for r in listings.scanned(names, bodies).collect()}
    return [(r["status"], r["undated"], r["failed"], [(i["url"].rsplit("/", 1)[1], i["title"], i["published_ts"]) for i in r["items"]]) for _, r in sorted(got.items())]


def article(title="T", date="2024-05-06T07:00:00Z", **more):
    meta = "".join(f'<meta property="{k}" content="{v}">' for k, v in more.items())
    return f"<html><head>{meta}<meta content='{date}' name='date'></head><body><h1>{title}</h1><p>Text.</p></body></html>"


def hrefs(*names):
    return "".join(f'<h2><a href="/a/{n}">x</a></h2>' for n in names)


AT = datetime(2024, 5, 6, 7)


@pytest.mark.parametrize("parser", ["links", "headings", "round_robin", "excerpts"])
def test_failures(spark, parser):
    strict = parser in ("links", "headings")
    pages = [
        [("https://x.org/0", hrefs("1", "2", "3"))], [("https://x.org/1", hrefs("1", "gone"))], [("https://x.org/2", None)], [("https://x.org/3", hrefs("undated"))], [("https://x.org/4", "")],
        [("https://x.org/5", hrefs("gone"))], [("https://x.org/6", hrefs("untitled", "1"))], [("https://x.org/7", hrefs("1")), ("https://x.org/7b", None), ("https://x.org/7c", hrefs("2"))],
    ]
    articles = {"1": article(), "2": article("h", **{"og:title": " ", "twitter:title": "A &amp; B"}), "3": article(date=""), "undated": article(date="soon"), "untitled": article("")}
    got = read(spark, parser, pages, articles)
    assert got[0] == ("ok", 1, 0, [("1", "T", AT), ("2", "A & B", AT)])
    assert got[1] == (("failed: article", 0, 1, []) if strict else ("ok", 0, 1, [("1", "T", AT)]))
    assert [g[0] for g in got[2:5]] == ["failed: listing", "failed: dates", "failed: nothing found"]
    assert got[5][0] == ("failed: article" if strict else "failed: articles") and got[6][0] == "failed: title"
    assert got[7][0] == "failed: listing" if strict else got[7][3] == [("1", "T", AT), ("2", "A & B", AT)]


def test_pages_in_turn_end_with_a_round_of_repeats(spark):
    pages = [[("https://x.org/0", hrefs("1", "2", "3", "9")), ("https://x.org/1", hrefs("4", "1", "3", "8"))], [("https://x.org/2", hrefs("1", "2")), ("https://x.org/3", hrefs("1", "2", "3"))]]
    articles = {str(i): article() for i in range(10)}
    order = lambda got: ["".join(u for u, _, _ in g[3]) for g in got]
    assert order(read(spark, "round_robin", pages, articles)) == ["142398", "123"] and order(read(spark, "excerpts", pages, articles)) == ["123948", "123"]
    assert order(read(spark, "round_robin", pages, articles, most=3)) == ["142", "123"]
    same = [[("https://x.org/0", hrefs("1", "2", "3", "5")), ("https://x.org/1", hrefs("2", "1", "3", "4", "6"))]]
    assert order(read(spark, "round_robin", same, articles)) == ["12"]  # the second round brings nothing new


def test_unknown_parser(spark):
    with pytest.raises(UnsupportedSource, match="l0: no parser 'other'"):
        read(spark, "other", [[("https://x.org/0", "")]], {})


def test_dates_of_a_page(spark):
    ld = '<script type="application/ld+json">%s</script>'
    cases = [
        (None, '<meta name="publish-date" content="bad"><meta name="date" content="2024-02-03">', datetime(2024, 2, 3)), (None, '<meta name="date" content=""><time class="x" datetime="2024-02-03T04:05:06+00:00">', datetime(2024, 2, 3, 4, 5, 6)),
        (None, ld % '{"datePublished": "2024-01-02"}', datetime(2024, 1, 2)), (None, ld % "{bad" + ld % '[1, {"dateCreated": "2024-01-05", "datePublished": ""}]', datetime(2024, 1, 5)), (None, ld % '{"dateModified": "2024-01-02"}', None),
        ("de", ld % '{"dateModified": "2024-01-02"}', datetime(2024, 1, 2)), ("de", "am 31. Februar 2024, 1.2.2024", None), ("de", "Nr. 4711 vom 1. MAERZ 2024", datetime(2024, 3, 1)), ("de", "am 7.8.2024", datetime(2024, 8, 7)), ("en", "7 August 2024", datetime(2024, 8, 7)),
        ("en", "17.8.2024 August", None), (None, "7 August 2024", None), ("en", "", None), ("de", None, None),
    ]
    df = spark.createDataFrame([(i, line, body) for i, (line, body, _) in enumerate(cases)], "i int, line string, body string")
    got = {r["i"]: r["d"] for r in df.select("i", listings.article_date(df["body"], df["line"]).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    assert str(spark.range(1).select(dates.german_date(F.lit("99.99.2024")).alias("d")).first()["d"]) == "None"

