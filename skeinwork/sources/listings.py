"""Listing pages: their links, the articles behind them, and what became of each listing.

Bodies have been landed by an ingest job and lie in a table, so reading a listing is two joins with
it: one for its pages, one for the articles that they name. Only what parses HTML runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skeinwork.functions.dates import english_date, feed_time, german_date
from skeinwork.functions.extract import let
from skeinwork.functions.text import clean_html
from skeinwork.functions.urls import external_id
from skeinwork.sources.pages import meta_map
from skeinwork.sources.registry import UnsupportedSource

#: Articles that a listing gives at most, where it doesn't say.
ARTICLES = 20
#: Characters and paragraphs of an article's excerpt.
EXCERPT, PARAGRAPHS = 900, 3
#: What a paragraph that isn't part of a story says.
NOT_STORY = ("newsletter", "login", "registrieren", "werben", "datenschutz", "subscribe", "sign up", "cookie")
#: Names under which pages give their date, and their title.
DATE_NAMES, TITLE_NAMES = ("article:published_time", "og:published_time", "publish-date", "date", "dc.date"), ("og:title", "twitter:title", "title")
_PRESS_PREFIX = re.compile(r"^Pressemitteilung\s+Nr\.?\s*\S+\s+vom\s+.+?(?=(Der|Die|Im|In|Mit|Für|Fuer)\b)", re.IGNORECASE)


@dataclass(frozen=True)
class Parser:
    """How a kind of listing is read.

    entries: the listing tells titles and dates itself. inside: only links within this tag count.
    by_turns: pages give their links in turn, not one page after another. alone: a page or an
    article that failed is left out alone; else its listing fails. bare: where the markup gives no
    link at all, hrefs are searched as text. excerpt: description and first paragraphs, not the
    first of them that there is. line: a date in the text counts, in this language.
    """

    entries: bool = False
    inside: str | None = None
    by_turns: bool = False
    alone: bool = False
    bare: bool = False
    excerpt: bool = False
    line: str | None = None


PARSERS = {
    "links_with_dates": Parser(entries=True),
    "links": Parser(bare=True),
    "round_robin": Parser(by_turns=True, alone=True, bare=True, line="en"),
    "excerpts": Parser(alone=True, excerpt=True, line="de"),
    "headings": Parser(inside="h2"),
}


class _Links(HTMLParser):
    """Targets of links in order; inside: of those within an open tag of that name."""

    def __init__(self, inside: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self._inside, self._open = inside, []

    def handle_starttag(self, tag, attrs):
        if self._inside:
            self._open.append(tag)
        href = dict(attrs).get("href") if tag == "a" else None
        if href and (not self._inside or self._inside in self._open):
            self.found.append(href)

    def handle_endtag(self, tag):
        if tag in self._open:  # closes what was left open inside it, too
            del self._open[len(self._open) - 1 - self._open[::-1].index(tag) :]


class _Entries(HTMLParser):
    """Links that match, each with its text, the text of date-like elements after it, and all other text up to the next."""

    def __init__(self, target) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self._target, self._where, self._dates, self._mute = target, "context", 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._mute = True
            return
        given = {k: v or "" for k, v in attrs}
        dated = tag == "time" or any("date" in given.get(k, "").lower() for k in ("class", "id", "data-testid"))
        self._dates += bool(self.found) and dated
        url = self._target(given["href"]) if tag == "a" and given.get("href") else None
        if url:
            self.found.append({"url": url, "title": [], "date": [], "context": []})
            self._where = "title"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._mute = False
            return
        self._dates -= bool(self._dates) and tag in ("time", "span", "div", "p")
        if tag == "a":
            self._where = "context"

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and self.found and not self._mute:
            self.found[-1]["date" if self._dates else self._where].append(text)


def links_of(body: str, base: str, parser: Parser, path: str, never: str | None = None, prefix: str | None = None) -> list[dict]:
    """url, title, date and context of a page's links whose path matches `path` and not `never`.

    prefix: a beginning of paths that some links repeat; the repeat is dropped. Only entries
    have more than a url, and only they may name a url twice.
    """

    def target(href: str) -> str | None:
        try:
            parts = urlparse(urljoin(base, href))
        except ValueError:
            return None
        if prefix and prefix + prefix.lstrip("/") in parts.path:
            parts = parts._replace(path=parts.path.replace(prefix + prefix.lstrip("/"), prefix, 1))
        return parts.geturl() if re.search(path, parts.path) and not (never and re.search(never, parts.path)) else None

    if parser.entries:
        reader = _Entries(target)
        reader.feed(body)
        reader.close()
        return [{k: v if k == "url" else " ".join(v) for k, v in e.items()} for e in reader.found]
    reader = _Links(parser.inside)
    reader.feed(body)
    reader.close()
    found = [u for u in map(target, reader.found) if u]
    if not found and parser.bare:
        found = [u for u in map(target, re.findall(r"""href\s*=\s*["']?([^"'\s>]+)""", body, re.IGNORECASE)) if u]
    return [{"url": u, "title": None, "date": None, "context": None} for u in dict.fromkeys(found)]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = pdf.to_dict("records")
        pdf["found"] = [links_of(r["body"], r["url"], PARSERS[r["parser"]], r["path"], r["never"], r["prefix"]) if r["body"] is not None else None for r in rows]
        yield pdf[["listing", "parser", "most", "page", "found"]]


def paragraphs(body: str) -> list[str]:
    """Cleaned paragraphs that say nothing of NOT_STORY, each once."""
    cleaned = (clean_html(p) for p in re.findall(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", body))
    return list(dict.fromkeys(p for p in cleaned if p and not any(s in p.lower() for s in NOT_STORY)))


def excerpt_of(description: str | None, body: str) -> str | None:
    """The description and as many first paragraphs as fit, none that is part of another; cut at a word."""
    parts = [description] if description else []
    for p in paragraphs(body):
        if any(p in q or q in p for q in parts):
            continue
        if parts and len(" ".join([*parts, p])) > EXCERPT:
            break
        parts.append(p)
        if len(parts) >= PARAGRAPHS:
            break
    text = " ".join(parts)
    if len(text) > EXCERPT:
        text = text[: EXCERPT + 1].rsplit(" ", 1)[0].rstrip(" ,;:-") or text[:EXCERPT]
    return text or None


def _first(candidates) -> str | None:
    return next((x for x in map(clean_html, candidates) if x), None)


@F.pandas_udf(StringType())
def _first_clean(candidates: pd.Series) -> pd.Series:
    """The first that isn't blank once cleaned."""
    return pd.Series([_first(c) for c in candidates], dtype=object)


@F.pandas_udf(StringType())
def _snippet(body: pd.Series, descriptions: pd.Series, excerpt: pd.Series) -> pd.Series:
    def one(b: str | None, d, e: bool) -> str | None:
        told = _first(d)
        if e:
            return excerpt_of(told, b or "")
        return told or next(iter(paragraphs(b or "")), None)

    return pd.Series([one(*row) for row in zip(body, descriptions, excerpt)], dtype=object)


@F.pandas_udf(StringType())
def _context_snippet(context: pd.Series, title: pd.Series) -> pd.Series:
    def one(c: str | None, t: str | None) -> str | None:
        rest = _PRESS_PREFIX.sub("", c or "").strip(" .")
        return None if t and t.lower() in rest.lower() else rest or None

    return pd.Series([one(*row) for row in zip(context, title)], dtype=object)


def article_date(body: Column, line: Column) -> Column:
    """A page's date: its meta tags by name, its first time tag, JSON-LD, then a line of its text (line: `en`, `de` or null). What is read of the page is read once."""
    told = lambda x: let(x, lambda v: F.coalesce(feed_time(v), F.when(line == "de", german_date(v).cast("timestamp"))))
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    kinds = "struct<datePublished:string,dateCreated:string,dateModified:string>"
    each = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(F.trim(b), "array<string>"), F.array(b))))  # a list of objects, or one
    nodes = F.transform(each, lambda x: F.from_json(x, kinds))
    blank = lambda x: F.nullif(x, F.lit(""))
    dates = F.transform(nodes, lambda n: told(F.coalesce(blank(n["datePublished"]), blank(n["dateCreated"]), F.when(line == "de", n["dateModified"]))))
    written = F.when(line == "de", german_date(body).cast("timestamp")).when(line == "en", english_date(body).cast("timestamp"))
    named = let(meta_map(body), lambda meta: F.coalesce(*[told(blank(meta[k])) for k in DATE_NAMES]))
    return F.coalesce(named, told(blank(F.regexp_extract(body, r"(?i)<time[^>]*datetime=[\"']([^\"']+)[\"']", 1))), F.get(F.filter(dates, lambda d: d.isNotNull()), 0), written)


def scanned(listings: DataFrame, bodies: DataFrame) -> DataFrame:
    """listing, status, undated, failed, items of every listing; items: pos, url, title, snippet, published_ts, external_id.

    listings: listing, parser (one of PARSERS; another raises), urls (its pages; all but the first
    are further ones), path (what a link's path must match) and, if they have them, never, prefix
    and most (articles). bodies: url, body; a body that is null or not there couldn't be fetched.

    A link counts once a listing, by its first sight; reading by turns ends with a round that
    brings nothing new. An article without a date is left out, one without a title fails its
    listing. status is ok, or failed and why; a listing that failed has no items. Null bodies and
    empty ones give no links; of several bodies of a url the longest counts.
    """
    has = lambda c, other: F.col(c) if c in listings.columns else other
    names = listings.select("listing", "parser", "urls", "path", has("never", F.lit(None).cast("string")).alias("never"), has("prefix", F.lit(None).cast("string")).alias("prefix"), F.coalesce(has("most", F.lit(None)), F.lit(ARTICLES)).cast("int").alias("most"))
    other = names.filter(~F.coalesce(F.col("parser").isin(*PARSERS), F.lit(False))).select("listing", "parser").first()
    if other:
        raise UnsupportedSource(f"{other['listing']}: no parser {other['parser']!r}")
    rule = lambda field: F.create_map(*[F.lit(x) for k, p in PARSERS.items() for x in (k, getattr(p, field))])[F.col("parser")]
    landed = bodies.groupBy("url").agg(F.max_by("body", F.length("body")).alias("body"))

    pages = names.select("*", F.posexplode("urls").alias("page", "url")).drop("urls").join(landed, "url", "left")
    entry = "array<struct<url:string,title:string,date:string,context:string>>"
    read = pages.mapInPandas(_read, f"listing {names.schema['listing'].dataType.simpleString()}, parser string, most int, page int, found {entry}")
    lost = (F.col("page") == 0) | ~rule("alone")
    lists = read.groupBy("listing").agg(F.bool_or(F.col("found").isNull() & lost).alias("lost"))
    links = read.select("listing", "parser", "most", "page", F.posexplode("found").alias("at", "link")).select("*", "link.*").drop("link")

    own = Window.partitionBy("listing")
    key = F.when(rule("by_turns"), F.struct(F.col("at").alias("a"), F.col("page").alias("b"))).otherwise(F.struct(F.col("page").alias("a"), F.col("at").alias("b")))
    links = links.withColumn("key", key).withColumn("new", (F.row_number().over(Window.partitionBy("listing", "url").orderBy("key")) == 1) | rule("entries"))
    links = links.withColumn("fresh", F.max("new").over(Window.partitionBy("listing", "at")))
    links = links.withColumn("end", F.min(F.when(~F.col("fresh") & rule("by_turns"), F.col("at"))).over(own)).filter("new and (end is null or at < end)")
    chosen = links.withColumn("pos", F.row_number().over(own.orderBy("key"))).filter((F.col("pos") <= F.col("most")) | rule("entries"))

    entries = chosen.filter(rule("entries")).filter("title <> ''")
    dated = german_date(F.concat_ws(" ", F.nullif("date", F.lit("")), "title", "context")).cast("timestamp")
    entries = entries.select("listing", "pos", "url", "title", _context_snippet("context", "title").alias("snippet"), dated.alias("published_ts"), F.lit(True).alias("got"), F.lit(False).alias("strict"))

    body, line = F.col("body"), rule("line")
    meta = lambda *keys: F.transform(F.array(*map(F.lit, keys)), lambda k: F.col("meta")[k])
    titles = F.array_append(meta(*TITLE_NAMES), F.regexp_extract(body, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    articles = chosen.filter(~rule("entries")).select("listing", "parser", "pos", "url").join(landed, "url", "left")
    articles = articles.withColumn("meta", meta_map(body)).withColumns({"titles": titles, "told": meta("description", "og:description"), "short": rule("excerpt")})
    articles = articles.select("listing", "pos", "url", _first_clean("titles").alias("title"), _snippet("body", "told", "short").alias("snippet"), article_date(body, line).alias("published_ts"), body.isNotNull().alias("got"), (~rule("alone")).alias("strict"))

    item = F.struct("pos", "url", "title", "snippet", "published_ts", external_id("url").alias("external_id"))
    good = F.col("got") & F.col("title").isNotNull() & F.col("published_ts").isNotNull()
    told = entries.unionByName(articles).groupBy("listing").agg(
        F.array_sort(F.collect_list(F.when(good, item))).alias("items"),
        F.count_if(F.col("got") & F.col("title").isNotNull() & F.col("published_ts").isNull()).alias("undated"),
        F.count_if(~F.col("got")).alias("failed"),
        F.bool_or(~F.col("got") & F.col("strict")).alias("broken"),
        F.bool_or(F.col("got") & F.col("title").isNull()).alias("untitled"),
    )
    out = names.select("listing").join(lists, "listing", "left").join(told, "listing", "left")
    status = (
        F.when(F.coalesce("lost", F.lit(True)), "failed: listing").when(F.col("broken"), "failed: article").when(F.col("untitled"), "failed: title")
        .when(F.size("items") > 0, "ok").when(F.col("failed") > 0, "failed: articles").when(F.col("undated") > 0, "failed: dates").otherwise("failed: nothing found")
    )
    none = F.array().cast(told.schema["items"].dataType)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("listing", status.alias("status"), zero("undated"), zero("failed"), F.when(status == "ok", F.col("items")).otherwise(none).alias("items"))


def items(read: DataFrame) -> DataFrame:
    """A row for each item of scanned()'s listings."""
    return read.select("listing", F.explode("items").alias("item")).select("listing", "item.*")
