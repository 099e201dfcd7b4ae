"""Queries of pages, feeds, summaries and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import text, urls
from skeinwork.operators import audit, relational as rel, summary
from skeinwork.plans.registry import Tables, query
from skeinwork.plans.text_queries import TITLE
from skeinwork.sources import feeds, pages, registry


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
def page_title_meta(t: Tables):
    return t.pages.select("page_id", pages.page_title("html").alias("title"), pages.page_lang("html").alias("lang"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1))) AS n FROM pages")
def page_links(t: Tables):
    return t.pages.select("page_id", F.size(pages.hrefs("html")).cast("long").alias("n"))


@query()
def listing_links(t: Tables):
    return pages.listing_links(t.pages, "^/[A-Za-z]")


@query()
def article_text(t: Tables):
    return pages.article_text(t.pages).select("page_id", "status", F.md5("article").alias("digest"), F.length("article").alias("n"))


@query("SELECT page_id, url AS first_link, 1 AS n FROM pages WHERE regexp_matches(url, '^https?://[^\\s<>\"'']+[^.,;:!?)\\]]$')")
def message_links(t: Tables):
    found = urls.links_in(F.concat(F.lit("see ("), "url", F.lit("). Again: "), "url", F.lit("!")))
    return t.pages.filter(F.col("url").rlike("[^.,;:!?)\\]]$")).select("page_id", found[0].alias("first_link"), F.size(found).alias("n"))


@query("SELECT doc_id, len(list_distinct(string_split(text, chr(10)))) AS blocks, len(string_split(text, chr(10))) AS lines FROM documents")
def block_dedupe(t: Tables):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(F.array_distinct(lines)).cast("long").alias("blocks"), F.size(lines).cast("long").alias("lines"))


@query(f"""SELECT place, doc_id FROM (SELECT doc_id, turn, row_number() OVER (ORDER BY turn, source) AS place, dense_rank() OVER (ORDER BY turn) AS round FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY turn, source) AS sight
           FROM (SELECT doc_id, source, {TITLE} AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)) WHERE sight = 1) WHERE place <= 40 AND round = turn""")
def interleave_round_robin(t: Tables):
    df = t.documents.select("doc_id", "source", text.title_of("text").alias("title"))
    return rel.round_robin(df, "source", "source", "doc_id", "title", 40).select(F.col("place").cast("long").alias("place"), "doc_id")




_BLOCK = "source || '/' || doc_id // 50"


@query(f"""SELECT {_BLOCK} AS source_id, 'https://news.example.org/' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN 'Salt & Pepper ' ELSE 'Title ' END || doc_id AS title, 'About ' || lang || ' ' || n_chars || ' & more' AS snippet, 'Ann' AS author,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 9 AS INT)) AS published_ts, 'g' || doc_id AS external_id FROM documents WHERE source IS NOT NULL AND ({_BLOCK} NOT IN (SELECT {_BLOCK} FROM documents WHERE source IS NOT NULL AND doc_id % 50 = 49) OR doc_id % 50 <> 49)""")
def feed_items(t: Tables):
    """Feeds of up to 50 documents of a source: some with bare ampersands, some cut off within their last item."""
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat(F.lit("Salt & Pepper "), n)).otherwise(F.concat(F.lit("Title "), n))
    item = F.concat(F.lit("<item><title>"), raw, F.when(n % 50 == 49, "<title>").otherwise("</title>"), F.format_string("<link>https://news.example.org/%d?utm_source=x</link><description>&lt;p&gt;About %s %d &amp;amp; more&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 0%d:00:00 GMT</pubDate><guid>g%d</guid><dc:creator>Ann</dc:creator></item>", n, F.col("lang"), F.col("n_chars").cast("long"), n % 9, n))
    block = F.concat(F.col("source"), F.lit("/"), F.expr("doc_id div 50"))
    feeds_of = t.documents.filter("source is not null").groupBy(block.alias("source_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("xs"))
    whole = F.concat(F.lit('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</channel></rss>"))
    body = F.when(F.exists("xs", lambda x: x["doc_id"] % 50 == 49), F.concat(whole, F.lit("<"))).otherwise(whole)
    out = feeds.rss_items(feeds_of.select("source_id", body.alias("body")))
    return out.select("source_id", urls.normalize_url("url").alias("url"), "title", "snippet", "author", "published_ts", "external_id")


@query(f"""SELECT {_BLOCK} AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'https://x.example.org/s-' || doc_id || '/' ELSE 'https://y.example.org/' || doc_id END AS url, 'A & B ' || doc_id AS title, 'Short ' || lang AS snippet, CAST(doc_id AS VARCHAR) AS external_id,
    TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(doc_id % 20 AS INT)) AS published_ts FROM documents WHERE source IS NOT NULL AND doc_id % 4 <> 3 AND doc_id // 50 % 7 <> 6""")
def wordpress_items(t: Tables):
    """Lists of posts, up to 50 documents each: a slug for a missing link, no title, lists that aren't JSON."""
    n, day = F.col("doc_id"), F.expr("date_add(DATE '2024-01-01', cast(doc_id % 20 as int))")
    link = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("https://y.example.org/"), n))
    post = F.struct(
        n.alias("id"), F.concat(F.lit("s-"), n).alias("slug"), link.alias("link"), F.concat(day, F.lit("T10:00:00")).alias("date"), F.concat(day, F.lit("T09:00:00")).alias("date_gmt"),
        F.struct(F.when(n % 4 == 3, "").otherwise(F.concat(F.lit("A &amp; B "), n)).alias("rendered")).alias("title"), F.struct(F.concat(F.lit("<p>Short "), "lang", F.lit("</p>")).alias("rendered")).alias("excerpt"),
    )
    lists = t.documents.filter("source is not null").groupBy("source", F.expr("doc_id div 50").alias("block")).agg(F.to_json(F.collect_list(post)).alias("body"))
    body = F.when(F.col("block") % 7 == 6, F.concat(F.lit("{"), "body")).otherwise(F.col("body"))
    return feeds.wordpress_items(lists.select(F.concat_ws("/", "source", "block").alias("source_id"), body.alias("body")), "https://x.example.org")


@query("""SELECT id, CASE n % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'listing' ELSE 'google_competitor' END AS kind, CASE WHEN n % 3 = 1 THEN 'x' || n END AS market_scope FROM (SELECT s_suppkey AS n, 's' || s_suppkey AS id FROM supplier) WHERE n % 5 <> 0 AND (n % 3 = 0 OR (n % 3 = 1 AND n % 2 = 0))""")
def source_registry(t: Tables):
    """Suppliers as a catalogue of sources: kinds, parsers that there are and that there aren't, some switched off."""
    n = F.col("s_suppkey")
    kind = F.when(n % 3 == 0, "rss").when(n % 3 == 1, "listing").otherwise("google_competitor")
    rows = t.supplier.select(F.concat(F.lit("s"), n).alias("id"), F.col("s_name").alias("name"), kind.alias("kind"), F.lit("direct").alias("layer"), F.lit(True).alias("is_direct_source"), F.lit(False).alias("is_wrapper"), (n % 5 != 0).alias("enabled"),
        F.when(n % 2 == 0, "headings").otherwise("other").alias("parser"), F.lit("https://example.org").alias("url"), F.lit(5).alias("priority"), F.when(n % 3 == 1, F.create_map(F.lit("market_scope"), F.concat(F.lit("x"), n))).alias("extra_config"))
    return registry.supported(registry.selected(rows)).select("id", "kind", F.col("extra_config")["market_scope"].alias("market_scope"))


@query()
def fallback_summary(t: Tables):
    """The whole text after its first line is what a summary draws on."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^[^\n]*\n?", ""), "\n", " ")
    return t.documents.select("doc_id", summary.fallback_summary(text.title_of("text"), body).alias("summary"))


@query()
def excerpts(t: Tables):
    return t.documents.select("doc_id", summary.excerpt(F.split("text", "\n")).alias("excerpt"))


@query()
def card_checks(t: Tables):
    df = t.pages.select("page_id", pages.page_title("html").alias("title"), text.cut_words(pages.page_title("html"), 40, ".").alias("summary"), "url")
    return df.select("page_id", summary.card_problem(F.col("title"), F.col("summary"), F.col("url")).alias("problem"), F.md5(summary.card("title", "summary", "url")).alias("card"))


@query("""SELECT CAST(line AS INT) AS line, text FROM (SELECT 3 + row_number() OVER (ORDER BY count(*) DESC, source) AS line, '| ' || source || ' | ' || count(*) || ' |' AS text FROM documents GROUP BY source
    UNION ALL SELECT * FROM (VALUES (0, '# Documents by source'), (1, ''), (2, '| source | n |'), (3, '| --- | --- |')) v(line, text))""")
def audit_report(t: Tables):
    counts = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return audit.markdown(counts, "Documents by source", [F.desc("n"), F.col("source")], ["source", "n"])
