"""Feeds and API lists: tolerant parsing of XML and JSON into raw items."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.dates import feed_time
from skeinwork.functions.text import clean_html, collapse, html_text

RAW_ITEM = "source_id string, url string, title string, snippet string, author string, published string, external_id string"
#: Names under which feeds give each field, best first.
FIELDS = {
    "title": ("title",), "snippet": ("description", "summary", "content", "encoded"), "author": ("creator", "author"),
    "published": ("pubDate", "published", "updated", "date"), "external_id": ("guid", "id"),
}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _text(node: ET.Element, names: tuple[str, ...]) -> str | None:
    for name in names:
        for child in node:
            if _local(child.tag) == name and (text := "".join(child.itertext()).strip()):
                return text
    return None


def _link(node: ET.Element) -> str | None:
    for child in node:
        if _local(child.tag) == "link":
            if found := (child.text or "").strip() or child.get("href", "").strip():
                return found
    return None


def repaired(xml: str) -> str:
    """Control signs dropped, bare ampersands escaped."""
    xml = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", xml)
    return re.sub(r"&(?!#?\w+;)", "&amp;", xml)


def _entries(xml: str) -> Iterator[ET.Element]:
    """Items at any depth: strictly, else repaired, else each item by itself, bad ones left out."""
    for text in (xml, repaired(xml)):
        try:
            yield from (n for n in ET.fromstring(text).iter() if _local(n.tag) in ("item", "entry"))
            return
        except ET.ParseError:
            continue
    for found in re.finditer(r"<(item|entry)\b.*?</\1>", repaired(xml), re.S):
        bare = re.sub(r"<(/?)[\w.-]+:([\w.-]+)", r"<\1\2", found[0])
        try:
            yield ET.fromstring(re.sub(r"\s[\w.-]+:[\w.-]+=(\"[^\"]*\"|'[^']*')", "", bare))
        except ET.ParseError:
            continue


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RAW_ITEM.split(", ")]
    for pdf in batches:
        rows = []
        for source, xml in zip(pdf["source_id"], pdf["body"]):
            for node in _entries(xml or ""):
                got = {k: _text(node, v) for k, v in FIELDS.items()} | {"source_id": source, "url": _link(node)}
                if got["url"] and got["title"]:
                    got |= {k: clean_html(got[k]) for k in ("title", "snippet")}
                    rows.append([got[n] for n in names])
        yield pd.DataFrame(rows, columns=names)


def rss_items(bodies: DataFrame) -> DataFrame:
    """Raw items of feed bodies (source_id, body); text cleaned by the workers that parse it, dates read."""
    out = bodies.select("source_id", "body").mapInPandas(_parse, RAW_ITEM)
    return out.withColumn("published_ts", feed_time("published"))


WP_POST = "array<struct<id:bigint,slug:string,link:string,status:string,date:string,date_gmt:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,content:struct<rendered:string>>>"


def wordpress_items(bodies: DataFrame, base_url: str) -> DataFrame:
    """Raw items of WordPress post lists (source_id, body); slug stands in for a missing link, GMT dates are preferred."""
    post = bodies.select("source_id", F.explode(F.from_json("body", WP_POST)).alias("p"))
    out = post.select(
        "source_id",
        F.coalesce(F.nullif(F.trim("p.link"), F.lit("")), F.concat(F.lit(base_url.rstrip("/") + "/"), F.nullif("p.slug", F.lit("")), F.lit("/"))).alias("url"),
        html_text("p.title.rendered").alias("title"), html_text(F.coalesce(F.nullif("p.excerpt.rendered", F.lit("")), "p.content.rendered")).alias("snippet"),
        F.col("p.id").cast("string").alias("external_id"), feed_time(F.coalesce("p.date_gmt", "p.date")).alias("published_ts"),
    )
    return out.filter("url is not null and title is not null")


#: candidates' confidence levels.
CONFIDENCE = ("low", "medium", "high")
CANDIDATE = "struct<candidates:array<struct<title:string,url:string,source_name:string,published_date:string,summary:string,query_pack_id:string,confidence:string>>>"


def search_candidates(bodies: DataFrame, packs: list[str]) -> DataFrame:
    """Candidates of search results: title and http(s) URL needed, first sight of a URL, unknown packs and confidences named so."""
    from pyspark.sql import Window

    c = bodies.select("body_id", F.posexplode(F.from_json("body", CANDIDATE)["candidates"]).alias("pos", "c")).select("body_id", "pos", "c.*")
    c = c.withColumns({"title": collapse("title"), "url": F.trim("url")}).filter("title is not null and url rlike '^https?://'")
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("body_id", "pos"))).filter("_r = 1").drop("_r")
    known = F.when(F.col("query_pack_id").isin(*packs), F.col("query_pack_id")).otherwise("unknown")
    sure = F.when(F.lower("confidence").isin(*CONFIDENCE), F.lower("confidence")).otherwise("low")
    return c.withColumns({"query_pack_id": known, "confidence": sure})


def url_list(lines: DataFrame, key: Column) -> DataFrame:
    """url_key, repeats of an allow-list's lines (value)."""
    return lines.filter(F.trim("value") != "").groupBy(key.alias("url_key")).agg((F.count("*") - 1).alias("repeats"))
