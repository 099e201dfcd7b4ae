"""HTML pages: titles, meta tags, dates, links and readable text."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skeinwork.functions.extract import let
from skeinwork.functions.text import col

BLOCKS, HIDDEN = frozenset({"p", "h1", "h2", "h3", "h4", "li", "div", "article", "section", "td", "blockquote"}), frozenset({"script", "style", "nav", "header", "footer", "aside", "form", "noscript"})
#: What blocks say that aren't part of an article, and what authors' biographies and the like say.
BOILERPLATE = (
    "cookie", "subscribe", "sign up", "privacy policy", "terms of use", "advertisement", "all rights reserved", "share this article", "enable javascript",
    "newsletter", "read more", "is a reporter", "is an editor", "follow us",
)
BIOGRAPHY = ("award-winning journalist", "years of experience", "coverage has reached audiences", "available for corporate", "in-house emcee", "recipient, he is passionate", "subscribe to our newsletter", "share copy link")
#: JSON-LD types of articles, and of what isn't one.
ARTICLES = frozenset({"article", "newsarticle", "reportagenewsarticle", "analysisnewsarticle", "blogposting", "techarticle"})
OTHERS = frozenset({"person", "organization", "webpage", "website", "breadcrumblist", "imageobject", "videoobject", "listitem"})
#: Characters that a block, and a JSON-LD text, must have at least and must exceed.
BLOCK, LD_TEXT = 45, 120


def page_title(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_lang(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1), F.lit(""))


def hrefs(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1)))


def meta_map(c: Column | str) -> Column:
    """Names or properties of meta tags with their content; the last of a name counts."""
    tags = F.regexp_extract_all(col(c), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)(?:name|property)=[\"']([^\"']*)[\"']", 1)).alias("k"), F.regexp_extract(t, r"(?i)content=[\"']([^\"']*)[\"']", 1).alias("v")))

    def mapped(named: Column) -> Column:
        keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda p: p["k"] == k), -1)["v"]))

    return let(F.filter(pairs, lambda p: p["k"] != ""), mapped)


def published(c: Column | str) -> Column:
    """A page's date: meta tag, else JSON-LD, else its first time tag."""
    x = col(c)
    json_ld = F.regexp_extract(x, r"\"datePublished\"\s*:\s*\"([^\"]+)\"", 1)
    time_tag = F.regexp_extract(x, r"(?i)<time[^>]*datetime=\"([^\"]+)\"", 1)
    return F.coalesce(*[F.try_to_timestamp(F.nullif(v, F.lit(""))) for v in (meta_map(x)["article:published_time"], json_ld, time_tag)])


class _Readable(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self._now: list[str] = []
        self._hidden = 0

    def _close(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self._now)).strip()
        self._now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        elif tag in BLOCKS:
            self._close()
        elif tag == "br":
            self._now.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag in BLOCKS:
            self._close()

    def handle_data(self, data):
        if not self._hidden:
            self._now.append(data)

    def close(self):
        super().close()
        self._close()


def article_blocks(text: str) -> list[str]:
    parser = _Readable()
    parser.feed(text)
    parser.close()
    blocks = [b for b in parser.blocks if len(b) >= BLOCK and not any(s in b.lower() for s in BOILERPLATE)]
    return list({b.lower(): b for b in reversed(blocks)}.values())[::-1]


def _ld_nodes(text: str) -> Iterator[dict]:
    """Objects of a page's JSON-LD scripts: single ones, those of lists and of graphs."""
    for found in re.finditer(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", text):
        try:
            told = json.loads(html.unescape(found[1]).strip())
        except ValueError:
            continue
        left = told if isinstance(told, list) else [told]
        while left:
            nodes = [n for n in left if isinstance(n, dict)]
            yield from nodes
            left = [m for n in nodes if isinstance(n.get("@graph"), list) for m in n["@graph"]]


def _json_ld_text(text: str) -> str | None:
    """The JSON-LD text that is likeliest the article, if any is: length counts, with 1,000 for a
    body and 500 for an article's type, less 1,000 for another's and 3,000 for a biography."""
    best, most = None, 0
    for node in _ld_nodes(text):
        named = node.get("@type")
        kinds = {k.strip().lower() for k in (named if isinstance(named, list) else [named]) if isinstance(k, str)}
        if kinds & OTHERS and not kinds & ARTICLES and "articleBody" not in node:
            continue
        for field, extra in (("articleBody", 1000), ("description", 0)):
            told = re.sub(r"\s+", " ", html.unescape(str(node.get(field) or ""))).strip()
            score = len(told) + extra + 500 * bool(kinds & ARTICLES) - 1000 * bool(kinds & OTHERS) - 3000 * any(s in told.lower() for s in BIOGRAPHY)
            if len(told) > LD_TEXT and score > most:
                best, most = told, score
    return best


def _read(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page in pdf["html"]:
            body = _json_ld_text(page or "")
            status = "json_ld" if body else "html"
            body = body or " ".join(article_blocks(page or ""))
            out.append((body[:limit] if limit else body, status if body else "empty"))
        yield pd.DataFrame({"page_id": pdf["page_id"], "article": [a for a, _ in out], "status": [s for _, s in out]})


def article_text(pages: DataFrame, limit: int = 0) -> DataFrame:
    """page_id, article, status: the best JSON-LD text before readable blocks; `empty` without either."""
    return pages.select("page_id", "html").mapInPandas(lambda b: _read(b, limit), "page_id long, article string, status string")


@F.pandas_udf(StringType())
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """Links resolved against their page."""
    return pd.Series([urljoin(b or "", x) if x else None for b, x in zip(base, link)])


def listing_links(pages: DataFrame, path: str) -> DataFrame:
    """page_id, pos, url of the links whose path matches, first sight on a page."""
    links = pages.select("page_id", "url", F.posexplode(hrefs("html")).alias("pos", "href")).filter(F.col("href").rlike(path))
    return links.select("page_id", "pos", joined("url", "href").alias("url"))
