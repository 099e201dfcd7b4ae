"""Queries of normalisation, tokens, rules and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import dates, extract, text, urls
from skeinwork.operators import audit, rules
from skeinwork.operators.rules import Flag, RuleBook
from skeinwork.operators.relational import interval_match
from skeinwork.operators.shared import stored
from skeinwork.plans.registry import Tables, query

TITLE = "substr(regexp_extract(coalesce(text, ''), '^[^\n]*'), 1, 80)"
_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower({TITLE}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"
KEY = f"coalesce(nullif(array_to_string(list_slice({TOKENS}, 1, 6), '-'), ''), 'untitled')"

#: Rules over the test tables' vocabulary.
BOOK = RuleBook(
    lexicons={
        "insult": ("idiot", "moron", "scum", "trash", "stupid", "pathetic", "worthless", "clown", "loser", "disgusting"),
        "licence": ("license", "licensed under", "released under", "all rights reserved", "copyright"),
        "english": ("of the", "and the", "in the", "to the", "is the"),
        "german": ("und", "der", "die", "ist", "nicht"),
        "french": ("les", "des", "une", "est", "avec"),
        "spanish": ("que", "los", "una", "por", "del"),
        "secret": ("password", "token", "secret", "api key", "akia"),
        "contact": ("http", "https", "www", "mailto"),
        "table": ("the", "of", "and"),
    },
    flags=(
        Flag("licence_notice", ("licence",), weight=-20),
        Flag("insulting", ("insult",), weight=-35),
        Flag("insulting_twice", ("insult",), at_least=2, weight=-15),
        Flag("english_prose", ("english",), ("german",), weight=25),
        Flag("german_prose", ("german",), ("english", "french"), weight=20),
        Flag("french_prose", ("french",), ("german",), weight=20),
        Flag("spanish_prose", ("spanish",), ("english",), weight=18),
        Flag("secret_word", ("secret",), weight=-16),
        Flag("contact_word", ("contact",), weight=-8),
        Flag("clean_english", ("english", "table"), ("insult", "licence", "secret"), weight=12),
    ),
)
_H = "lower(coalesce(text, ''))"
FLAGS_SQL = ", ".join(f"({BOOK.sql(f, _H)}) AS {f.name}" for f in BOOK.flags)
NAMES = [f.name for f in BOOK.flags]
SCORE_SQL = " + ".join(f"CASE WHEN {f.name} THEN {f.weight} ELSE 0 END" for f in BOOK.flags)
FLAGGED_SQL = f"SELECT doc_id, source, lang, text, {FLAGS_SQL} FROM documents"
GATE_SQL = "CASE WHEN insulting THEN 'insult' WHEN secret_word AND NOT clean_english THEN 'secret' WHEN licence_notice AND n < 400 THEN 'licence_only' WHEN NOT (" + " OR ".join(f.name for f in BOOK.flags) + ") THEN 'no_signal' WHEN score < 12 THEN 'low_score' END"


def flagged(t: Tables):
    return BOOK.flagged(t.documents, F.lower(F.coalesce("text", F.lit(""))))


def gated(t: Tables):
    df = flagged(t).withColumn("score", BOOK.score())
    cases = [
        (F.col("insulting"), "insult"), (F.col("secret_word") & ~F.col("clean_english"), "secret"), (F.col("licence_notice") & (F.length("text") < 400), "licence_only"),
        (~rules.any_flag(NAMES), "no_signal"), (F.col("score") < 12, "low_score"),
    ]
    return df.withColumn("gate", rules.gate(cases)).withColumns({"status": F.col("gate.status"), "reason": F.col("gate.reason")}).drop("gate")


@query("SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), '')) AS digest, length(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS size FROM documents")
def normalize_text(t: Tables):
    c = text.collapse("text")
    return t.documents.select("doc_id", F.md5(F.coalesce(c, F.lit(""))).alias("digest"), F.length(c).cast("long").alias("size"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def story_text(t: Tables):
    return t.documents.select("doc_id", F.md5(text.story_text("text")).alias("digest"))


@query(f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens, CAST(len({TOKENS}) AS INT) AS n FROM documents")
def title_tokens(t: Tables):
    tok = text.tokens(text.title_of("text"))
    return t.documents.select("doc_id", F.array_join(tok, " ").alias("tokens"), F.size(tok).alias("n"))


@query(f"SELECT doc_id, {KEY} AS event_key FROM documents")
def event_key(t: Tables):
    return t.documents.select("doc_id", text.event_key(text.title_of("text")).alias("event_key"))


@query(f"SELECT {KEY} AS event_key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def event_key_groups(t: Tables):
    return t.documents.groupBy(text.event_key(text.title_of("text")).alias("event_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, CAST(regexp_extract_all(trim(text), '[.!?]\\s+[^\\s]').len() + 1 AS INT) AS n FROM documents WHERE trim(text) <> ''")
def sentence_count(t: Tables):
    return t.documents.filter(F.trim("text") != "").select("doc_id", F.size(text.sentences("text")).alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) <= 110 THEN text ELSE rtrim(coalesce(nullif(regexp_extract(substr(text, 1, 110), '(?s)^(.*)\\s\\S*$', 1), ''), substr(text, 1, 110))) || '...' END AS head FROM documents")
def cut_at_word(t: Tables):
    return t.documents.select("doc_id", text.cut_words("text", 110, "...").alias("head"))


@query("SELECT page_id, replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(regexp_replace(url, '\\s+', ' ', 'g'), '|', '\\|') AS cell FROM pages")
def escaped_cells(t: Tables):
    return t.pages.select("page_id", text.escaped(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("escaped"), text.table_cell("url").alias("cell"))


@query("SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS raw_host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages")
def url_host(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("raw_host"), urls.host("url").alias("host"))


_BARE = "regexp_extract(url, '^([^#]*)', 1)"
_KEPT = f"list_filter(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|mc_|fbclid|gclid)'))"


@query(f"SELECT page_id, regexp_extract({_BARE}, '^([^?]*)', 1) || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END AS url FROM pages")
def normalize_url(t: Tables):
    return t.pages.select("page_id", urls.normalize_url("url").alias("url"))


@query("SELECT page_id, CAST(regexp_matches(url, '^[A-Z]') AS BOOLEAN) AS odd, count(*) OVER (PARTITION BY regexp_replace(regexp_replace(regexp_extract(url, '^([^#]*)', 1), '/+$', ''), '^(.*)$', '\\1')) AS same FROM pages")
def url_key_groups(t: Tables):
    from pyspark.sql import Window

    return t.pages.select("page_id", F.col("url").rlike("^[A-Z]").alias("odd"), F.count("*").over(Window.partitionBy(urls.url_key("url"))).alias("same"))


@query("SELECT page_id, nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '') AS external_id FROM pages")
def external_id(t: Tables):
    return t.pages.select("page_id", urls.external_id("url").alias("external_id"))


@query(f"SELECT doc_id, {', '.join(NAMES)} FROM ({FLAGGED_SQL})")
def lexicon_flags(t: Tables):
    return flagged(t).select("doc_id", *NAMES)


@query("SELECT doc_id, " + ", ".join("CAST(" + " + ".join(f"CAST(regexp_matches({_H}, '{rules.sql_term_pattern([w])}') AS INT)" for w in BOOK.lexicons[s]) + f" AS INT) AS {s}_terms" for s in ("insult", "german", "french")) + " FROM documents")
def term_counts(t: Tables):
    sets = {f"{s}_terms": BOOK.lexicons[s] for s in ("insult", "german", "french")}
    return rules.term_counts(t.documents, F.lower(F.coalesce("text", F.lit(""))), sets).select("doc_id", *sets)


@query(f"SELECT doc_id, contains({_H}, 'license') OR contains({_H}, '!!') AS hit FROM documents")
def plain_contains(t: Tables):
    return t.documents.select("doc_id", rules.contains_plain(F.lower(F.coalesce("text", F.lit(""))), ("license", "!!")).alias("hit"))


@query(f"SELECT doc_id, CAST({SCORE_SQL} AS INT) AS score FROM ({FLAGGED_SQL})")
def flag_score(t: Tables):
    return flagged(t).select("doc_id", BOOK.score().alias("score"))


@query(f"SELECT doc_id, CASE WHEN r IS NULL THEN 'keep' ELSE 'drop' END AS status, r AS reason FROM (SELECT doc_id, {GATE_SQL} AS r FROM (SELECT *, {SCORE_SQL} AS score, length(text) AS n FROM ({FLAGGED_SQL})))")
def relevance_gate(t: Tables):
    return gated(t).select("doc_id", "status", "reason")


BUCKETS = [("insulting_twice", "abuse"), ("licence_notice", "legal"), ("secret_word", "security"), ("clean_english", "english"), ("german_prose", "german"), ("french_prose", "french"), ("spanish_prose", "spanish")]
BUCKET_SQL = "CASE " + " ".join(f"WHEN {f} THEN '{b}'" for f, b in BUCKETS) + " ELSE 'other' END"


@query(f"SELECT doc_id, {BUCKET_SQL} AS bucket FROM ({FLAGGED_SQL})")
def weekly_bucket(t: Tables):
    return flagged(t).select("doc_id", rules.first_match([(F.col(f), b) for f, b in BUCKETS], "other").alias("bucket"))


@query("SELECT name, n FROM (SELECT " + ", ".join(f"count(*) FILTER ({n}) AS {n}" for n in NAMES) + f" FROM ({FLAGGED_SQL})) UNPIVOT (n FOR name IN ({', '.join(NAMES)}))")
def flag_counts(t: Tables):
    return audit.flag_counts(flagged(t), NAMES)


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {n} THEN {chr(39)}{n}{chr(39)} END' for n in NAMES)}], lambda x: x IS NOT NULL)), ', ') AS enabled FROM ({FLAGGED_SQL})")
def enabled_flags(t: Tables):
    return flagged(t).select("doc_id", audit.enabled(NAMES).alias("enabled"))


@query(f"SELECT doc_id, CAST({' + '.join(f'CAST({f.name} AS INT)' for f in BOOK.flags if f.weight > 0)} AS INT) AS positive, CAST({' + '.join(f'CASE WHEN {f.name} AND {f.weight} <> 0 THEN 1 ELSE 0 END' for f in BOOK.flags)} AS INT) AS applied FROM ({FLAGGED_SQL})")
def applied_weights(t: Tables):
    positive = sum((F.col(f.name).cast("int") for f in BOOK.flags if f.weight > 0), F.lit(0))
    return flagged(t).select("doc_id", positive.alias("positive"), F.size(BOOK.applied()).alias("applied"))


@query("SELECT event_id, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 HOUR AND TIMESTAMP '2024-01-15 12:00:00' THEN 'fresh' ELSE 'stale' END AS status FROM events")
def freshness_status(t: Tables):
    return t.events.select("event_id", dates.freshness(F.col("ts"), F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp"), 30).alias("status"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 48 HOUR THEN 'fresh' ELSE 'stale' END WHEN ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-15 12:00:00' THEN 'fresh' ELSE 'stale' END AS status FROM events")
def freshness_fallback(t: Tables):
    published = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select("event_id", dates.freshness(published, F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp"), 48, fall_back=True).alias("status"))


@query("SELECT event_id, datediff('day', CAST(ts AS DATE), DATE '2024-01-20') BETWEEN 0 AND 7 AND event_type IN ('view', 'click') AS recovered FROM events")
def stale_recovery(t: Tables):
    age = F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts"))
    return t.events.select("event_id", (age.between(0, 7) & F.col("event_type").isin("view", "click")).alias("recovered"))


_END = "CAST(o_orderdate AS DATE) + CAST((11 - isodow(CAST(o_orderdate AS DATE))) % 7 AS INT)"


@query(f"SELECT e AS week_end, e - 6 AS week_start, isoyear(e) || '-W' || lpad(CAST(weekofyear(e) AS VARCHAR), 2, '0') AS week_key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT {_END} AS e, o_totalprice FROM orders) GROUP BY e")
def fri_thu_window(t: Tables):
    df = t.orders.select(dates.week_end("o_orderdate").alias("week_end"), "o_totalprice")
    out = df.groupBy("week_end").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.select("week_end", F.date_sub("week_end", 6).alias("week_start"), dates.week_key("week_end").alias("week_key"), "n", "total")


@query(f"SELECT DISTINCT e AS week_end, CASE WHEN year(s) = year(e) AND month(s) = month(e) THEN day(s) || '-' WHEN year(s) = year(e) THEN day(s) || ' ' || monthname(s) || '-' ELSE day(s) || ' ' || monthname(s) || ' ' || year(s) || '-' END || day(e) || ' ' || monthname(e) || ' ' || year(e) AS label FROM (SELECT {_END} AS e, {_END} - 6 AS s FROM orders)")
def week_label(t: Tables):
    end = dates.week_end("o_orderdate")
    df = t.orders.select(end.alias("week_end")).distinct()
    return df.select("week_end", dates.range_label(F.date_sub("week_end", 6), F.col("week_end")).alias("label"))


@query("SELECT o_orderkey, isoyear(o_orderdate) AS iso_year, weekofyear(o_orderdate) AS iso_week FROM orders")
def iso_week(t: Tables):
    return t.orders.select("o_orderkey", F.extract(F.lit("YEAROFWEEK"), "o_orderdate").cast("long").alias("iso_year"), F.weekofyear("o_orderdate").cast("long").alias("iso_week"))


def order_stories(t: Tables, *more: str):
    """Orders told as fundings, deployments and partnerships of their customers, in several wordings; every fifth says nothing."""
    k, who = F.col("o_orderkey"), F.lpad("o_custkey", 6, "0")
    millions, robots = (F.col("o_totalprice") / 10000).cast("int"), F.col("o_custkey") + 1000
    name, other = F.concat(F.lit("Acme"), who), F.concat(F.lit("Delta"), who)
    grouped = F.format_number(robots, 0)
    title = (
        F.when(k % 5 == 0, F.concat(name, F.lit(" Robotics raises $"), millions, F.lit(" million in Series B"))).when(k % 5 == 1, F.concat(F.lit("Report: "), name, F.lit(" Robotics has just raised $"), millions, F.lit("m Series B")))
        .when(k % 5 == 2, F.concat(name, F.lit(" and "), other, F.lit(" Works deploy "), grouped, F.lit(" humanoids"))).when(k % 5 == 3, F.concat(name, F.lit(" partners with "), other, F.lit(" Group"))).otherwise("Nothing to see")
    )
    preview = F.when(k % 5 == 2, F.concat(name, F.lit(" and "), other, F.lit(" Works deploy "), grouped, F.lit(" Atlas robots in plants."))).when(k % 5 == 3, F.concat(name, F.lit(" partners with "), other, F.lit(" Group on housing.")))
    return t.orders.select("o_orderkey", title.alias("title"), preview.alias("preview"), F.col("o_orderdate").cast("timestamp").alias("published"), *more)


_NAME = "lpad(CAST(o_custkey AS VARCHAR), 6, '0')"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN 'acme' || {_NAME} || ' robotics' END AS funder, CASE WHEN o_orderkey % 5 < 2 THEN '$' || CAST(floor(o_totalprice / 10000) AS INT) || 'm' END AS amount, CASE WHEN o_orderkey % 5 < 2 THEN 'series b' END AS round,
           CASE WHEN o_orderkey % 5 = 2 THEN 'acme' || {_NAME} || '+delta' || {_NAME} || ' works' END AS deployers, CASE WHEN o_orderkey % 5 = 2 THEN CAST(o_custkey + 1000 AS VARCHAR) END AS quantity, CASE WHEN o_orderkey % 5 = 2 THEN 'atlas robots' END AS product,
           CASE WHEN o_orderkey % 5 = 3 THEN 'acme' || {_NAME} || '+delta' || {_NAME} || ' group' END AS partners FROM orders""")
def semantic_keys(t: Tables):
    """Funding, deployment and partnership keys of stories composed from orders."""
    f, d = extract.funding_key("title", "preview", "published"), extract.deployment_key("title", "preview", "published")
    pair = extract.partnership_pair(F.concat_ws(". ", "title", "preview"))
    return order_stories(t).select("o_orderkey", f["entity"].alias("funder"), F.concat(f["amount"]["currency"], f["amount"]["value"], f["amount"]["scale"]).alias("amount"), f["round"].alias("round"), F.array_join(d["pair"], "+").alias("deployers"), d["quantity"].alias("quantity"), d["product"].alias("product"), F.array_join(pair, "+").alias("partners"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice / 10000) AS INT) AS m, CAST(o_orderdate AS DATE) AS d FROM orders)
          SELECT x.k AS a, y.k AS b FROM s x JOIN s y ON x.c = y.c AND x.k < y.k WHERE (x.k % 5 < 2 AND y.k % 5 < 2 AND x.m = y.m AND abs(datediff('day', x.d, y.d)) <= 3) OR (x.k % 5 = 2 AND y.k % 5 = 2 AND abs(datediff('day', x.d, y.d)) <= 7)""")
def same_story_pairs(t: Tables):
    """Pairs of orders' stories that tell of one funding or deployment; they meet by a name and a span of days."""
    k = stored(order_stories(t).select("o_orderkey", "published", extract.funding_key("title", "preview", "published").alias("f"), extract.deployment_key("title", "preview", "published").alias("d")))
    keyed = k.withColumn("name", F.explode(F.array_compact(F.array_distinct(F.concat(F.array("f.entity"), F.coalesce("d.pair", F.array().cast("array<string>")))))))
    both = interval_match(keyed.withColumnRenamed("o_orderkey", "id"), keyed.withColumnRenamed("o_orderkey", "id"), "name", "published", 8).filter(F.col("l.id") < F.col("r.id"))
    same = F.coalesce(extract.same_funding(F.col("l.f"), F.col("r.f")), F.lit(False)) | F.coalesce(extract.same_deployment(F.col("l.d"), F.col("r.d")), F.lit(False))
    return both.filter(same).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


_MONEY = "(?i)[$€£]\\s?(\\d+(?:\\.\\d+)?)\\s?(million|billion|mn|mm|bn|m|b)?\\b"


@query("SELECT o_orderkey, '$' AS currency, CASE WHEN CAST(o_totalprice AS BIGINT) % 2 = 0 THEN 'm' ELSE 'b' END AS scale, CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS value FROM orders")
def amount_extract(t: Tables):
    whole = F.bround("o_totalprice", 0).cast("long")
    story = F.concat(F.lit("Order of £1 m: Clerk raises $"), whole.cast("string"), F.lit(".0 "), F.when(whole % 2 == 0, "million").otherwise("bn"), F.lit(" today"))
    a = extract.amount(story)
    return t.orders.select("o_orderkey", a["currency"].alias("currency"), a["scale"].alias("scale"), a["value"].alias("value"))
