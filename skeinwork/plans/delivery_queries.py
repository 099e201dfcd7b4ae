"""Queries of deliveries, landed bodies, payloads, diagnostics and repeated angles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import extract
from skeinwork.operators import delivery, history, models, relational, reviews, rules, runs
from skeinwork.plans.registry import Tables, query
from skeinwork.rulesets import discovery
from skeinwork.sources import landed

_STORY = """'<b>Story</b> <a href="https://' || CASE WHEN k % 9 = 0 THEN 'example.com' ELSE 'news.org' END || '/">' || CASE WHEN k % 8 = 0 THEN 'More' ELSE 'Link' END || '</a>'"""
_MESSAGE = f"""CASE WHEN k % 5 > 0 THEN 'Top 5 News Highlights | ' ELSE 'News ' END || chr(10) || array_to_string(list_transform(range(1, 5 + k % 7 - 1), lambda i: i || '. ' || {_STORY}), chr(10))
    || CASE WHEN k % 6 = 0 THEN ' see https://x.org' ELSE '' END || CASE WHEN k % 11 = 0 THEN repeat('long ', 900) ELSE '' END"""


@query(f"""SELECT k AS o_orderkey, CASE WHEN NOT starts_with(m, 'Top 5 News Highlights |') THEN 'title' WHEN length(m) >= 4096 THEN 'length' WHEN len(regexp_extract_all(m, '(?m)^\\s*\\d+\\.\\s*<b>')) < 5 THEN 'stories'
    WHEN NOT (contains(m, '<a href="') AND contains(m, '>Link</a>')) THEN 'links' WHEN contains(m, 'example.com') THEN 'placeholder' WHEN regexp_matches(regexp_replace(m, '<a href="[^"]+">Link</a>', 'Link', 'g'), 'https?://') THEN 'url' END AS problem
    FROM (SELECT k, {_MESSAGE} AS m FROM (SELECT o_orderkey AS k FROM orders))""")
def artefact_checks(t: Tables):
    """A week's message of each order, sound or with one fault or several."""
    k = F.col("o_orderkey")
    site, name = F.when(k % 9 == 0, "example.com").otherwise("news.org"), F.when(k % 8 == 0, "More").otherwise("Link")
    story = F.concat(F.lit('<b>Story</b> <a href="https://'), site, F.lit('/">'), name, F.lit("</a>"))
    stories = F.transform(F.sequence(F.lit(1), (k % 7 + 3).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(". "), story))
    message = F.concat(F.when(k % 5 > 0, "Top 5 News Highlights | ").otherwise("News "), F.lit("\n"), F.array_join(stories, "\n"), F.when(k % 6 == 0, " see https://x.org").otherwise(""), F.when(k % 11 == 0, F.repeat(F.lit("long "), 900)).otherwise(""))
    return t.orders.select("o_orderkey", delivery.artefact_problem(message).alias("problem"))


_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(trim(coalesce(text, '')), ''), 'none'), 'https?://\\S+', '', 'g'), '(?i)^\\s*insider brief[:\\s\\-]*', ''), '\\s+', ' ', 'g'), ' .')"""


@query(f"""SELECT doc_id, md5(CASE WHEN len(p) = 0 THEN c ELSE array_to_string(list_slice(p, 1, 2), '. ') || '.' END) AS digest FROM (SELECT doc_id, c, list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' .')), lambda s: s <> '') AS p
    FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))""")
def digest_grounding(t: Tables):
    """What a digest may say of each document: its first two sentences."""
    return t.documents.select("doc_id", F.md5(delivery.grounding(F.lit("none"), "text")).alias("digest"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Insider Brief: ' || x || CASE WHEN doc_id % 2 = 0 THEN ' Subscribe to our letter' ELSE '' END, '(?i)^\\s*insider brief\\s*[:.\\-]?\\s*', ''), '(?i)^\\s*brief\\s*[:.\\-]\\s*', ''),
    '(?i)\\bread more\\b.*', ''), '(?i)\\bsubscribe to .*', ''), '\\s+', ' ', 'g'))) AS digest FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS x FROM documents)""")
def boilerplate_strip(t: Tables):
    x = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    full = F.concat(F.lit("Insider Brief: "), x, F.when(F.col("doc_id") % 2 == 0, " Subscribe to our letter").otherwise(""))
    return t.documents.select("doc_id", F.md5(delivery.without_boilerplate(full)).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN c = '' AND o_orderkey % 4 = 1 THEN 'An order is open.' WHEN c = '' AND o_orderkey % 4 = 2 THEN 'An order is done.' WHEN c = '' THEN 'An order.' WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS paragraph
    FROM (SELECT o_orderkey, trim(regexp_replace(regexp_replace(CASE WHEN o_orderkey % 3 = 0 THEN ' https://a.org/x ' ELSE o_orderpriority || '  by https://a.org ' || o_clerk || '!' END, 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g'), ' .') AS c FROM (SELECT *, 'clerk' AS o_clerk FROM (SELECT o_orderkey, o_orderpriority FROM orders)))""")
def digest_paragraph(t: Tables):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, " https://a.org/x ").otherwise(F.concat("o_orderpriority", F.lit("  by https://a.org clerk!")))
    return t.orders.select("o_orderkey", delivery.paragraph(text, [(k % 4 == 1, "An order is open."), (k % 4 == 2, "An order is done.")], "An order.").alias("paragraph"))


@query("SELECT CAST(to_json(list(struct_pack(o_orderkey := o_orderkey, o_orderpriority := o_orderpriority) ORDER BY o_totalprice DESC, o_orderkey)) AS VARCHAR) AS payload FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12)")
def prompt_payload(t: Tables):
    return delivery.payload(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_orderpriority"], 12)


@query("""SELECT page_id AS card_id, chat AS chat_id, 'skipped' AS status, CAST(NULL AS VARCHAR) AS note FROM pages, (VALUES ('-1'), ('-2')) c(chat)""")
def chat_deliveries(t: Tables):
    """A result of each card and chat; nothing is sent without a sender."""
    return delivery.sent(t.pages.select(F.col("page_id").alias("card_id"), "html"), ["-1", "-2"])


@query("""SELECT listing, mirror, attempt, CAST(0.5 * attempt * (attempt - 1) / 2 AS DOUBLE) AS waited, CASE WHEN attempt IS NOT NULL THEN 'ok' ELSE 'failed: ' || coalesce(CAST(last AS VARCHAR), 'timeout') END AS fetch_status FROM (
      SELECT listing, min_by(mirror, mirror) FILTER (good IS NOT NULL) AS mirror, min_by(good, mirror) FILTER (good IS NOT NULL) AS attempt, (list(last[1] ORDER BY mirror DESC))[1] AS last FROM (
        SELECT listing, mirror, CASE WHEN final IS NULL OR ok < final THEN ok END AS good, last FROM (
          SELECT listing, mirror, min(attempt) FILTER (status BETWEEN 200 AND 299) AS ok, min(attempt) FILTER (status IS NOT NULL AND status NOT BETWEEN 200 AND 299 AND status <> 429 AND status < 500) AS final, list(status ORDER BY attempt DESC) AS last
          FROM (SELECT user_id AS listing, event_id % 3 AS mirror, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS attempt, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 503 WHEN 'error' THEN 404 WHEN 'purchase' THEN 429 END AS status FROM events)
          WHERE attempt <= 3 GROUP BY 1, 2)) GROUP BY 1)""")
def listing_attempts(t: Tables):
    """Events told as fetches of three mirrors a listing: the first mirror that answered, after how many attempts."""
    from pyspark.sql import Window

    status = F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 503).when(F.col("event_type") == "error", 404).when(F.col("event_type") == "purchase", 429)
    tries = t.events.select(F.col("user_id").alias("listing"), (F.col("event_id") % 3).alias("mirror"), F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("event_id")).cast("long").alias("attempt"), status.alias("status"))
    return landed.first_answers(tries)


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + 2 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS keys, CASE WHEN o_orderkey % 2 = 0 THEN 'high' END AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_orderpriority END AS last_kind FROM orders""")
def diagnostics_merge(t: Tables):
    """Notes of a review, a card and a source as one map; of a key that two have the later counts."""
    review = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("confidence"), F.lit("high")))
    card, source = F.create_map(F.lit("kind"), F.col("o_orderpriority"), F.lit("writer"), F.lit("x")), F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("kind"), F.col("o_orderstatus")))
    both = runs.merged_maps(card, source)
    all_ = runs.diagnostics(review, card, source)
    return t.orders.select("o_orderkey", F.size(all_).alias("keys"), all_["review.confidence"].alias("confidence"), both["kind"].alias("last_kind"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND (o_totalprice >= 200000 OR o_orderkey % 7 = 0 OR o_totalprice / 10000 >= 22) AS eligible FROM orders""")
def review_eligibility(t: Tables):
    """Which orders, told as items, a reviewer sees: fresh, kept, not skipped, and listed, borderline or nearly good enough to be sent."""
    k = F.col("o_orderkey")
    out = reviews.eligible(F.col("o_orderstatus") == "F", k % 3 != 0, F.lit(False), F.col("o_totalprice") >= 200000, k % 7 == 0, F.col("o_totalprice") / 10000, 28)
    return t.orders.select("o_orderkey", out.alias("eligible"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'license') AND lang = 'en' THEN ['keep the licence', 'in English'] WHEN regexp_matches(lower(coalesce(text, '')), 'license') THEN ['keep the licence'] WHEN lang = 'en' THEN ['in English'] ELSE [] END::VARCHAR[] AS notes_list, 1 AS one FROM documents""".replace("AS notes_list, 1 AS one", "AS notes"))
def guard_notes(t: Tables):
    """What to mind when a document is written about."""
    return t.documents.select("doc_id", rules.notes([(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("license")), "keep the licence"), (F.col("lang") == "en", "in English")]).alias("notes"))


_ROUND = "CASE c % 3 WHEN 0 THEN 'Seed round' WHEN 1 THEN 'Series B' ELSE '' END"


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(o_totalprice AS BIGINT) // 100000 + 1 AS n, o_orderstatus AS st, o_orderdate AS told, o_totalprice AS score FROM orders),
          r AS (SELECT c, min_by(id, struct_pack(a := -score, b := -epoch(told), d := 'https://o.example.org/' || id, e := id)) AS representative FROM s WHERE st = 'F' AND c % 2 = 0 GROUP BY c)
          SELECT s.id AS item_id, r.representative FROM s JOIN r USING (c) WHERE s.st = 'O'""")
def repeated_angles(t: Tables):
    """Open orders told as stories of a company's data factory that finished ones have told already."""
    name = F.concat(F.lit("Maker"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    o = t.orders.select(F.col("o_orderkey").alias("item_id"), "o_orderstatus", F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("at"), F.concat(F.lit("https://o.example.org/"), "o_orderkey").alias("url"),
                        F.concat(name, F.lit(" unveils a new line")).alias("title"), F.when(F.col("o_custkey") % 2 == 0, "A robot data factory near its headquarters.").otherwise("A robot cell.").alias("preview"))
    keyed = o.withColumn("key", extract.repeat_key("title", "preview", F.lit(False)))
    return history.repeated_angles(keyed.filter("o_orderstatus = 'O'"), keyed.filter("o_orderstatus = 'F'"))


@query(f"""SELECT k AS o_orderkey, 'maker' || lpad(CAST(c AS VARCHAR), 6, '0') AS entity, CAST(n AS VARCHAR) AS value, lower(nullif({_ROUND}, '')) AS round, c % 4 = 0 AS valuation, CASE WHEN c % 5 = 0 THEN 'gripper' WHEN c % 5 = 1 THEN 'robotic_hand' END AS component,
    array_to_string(CASE WHEN c % 2 = 0 THEN ['north fund'] ELSE ['north fund', 'south capital'] END, '+') AS investors, CAST(2 - CASE WHEN c % 6 = 0 THEN 1 ELSE 0 END AS INT) AS framing
    FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice / 1000) AS BIGINT) + 1 AS n FROM orders)""")
def funding_facts(t: Tables):
    """Entity, amount, round, investors, valuation and component of a funding story of each order."""
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.floor(F.col("o_totalprice") / 1000) + 1
    name = F.concat(F.lit("Maker"), F.lpad(c.cast("string"), 6, "0"))
    round_ = F.when(c % 3 == 0, " in a Seed round").when(c % 3 == 1, " in a Series B").otherwise("")
    tease = F.when(c % 6 == 0, ": here's why").otherwise("")
    title = F.concat(name, F.lit(" raises $"), n.cast("string"), F.lit(".0 million"), round_, tease)
    made = F.when(c % 5 == 0, "It makes end-effectors. ").when(c % 5 == 1, "It makes dexterous hands. ").otherwise("")
    preview = F.concat(made, F.when(c % 4 == 0, "It was valued at more. ").otherwise(""), F.lit("The money was led by North Fund"), F.when(c % 2 == 0, ".").otherwise(" and backed by South Capital."))
    f = extract.run_funding(title, preview, F.col("o_orderdate"))
    told = relational.spread(t.orders).select("o_orderkey", f.alias("f"), extract.framing(title, "funding").alias("framing"))
    return told.select("o_orderkey", F.col("f.entity").alias("entity"), F.col("f.amount.value").alias("value"), F.col("f.round").alias("round"), F.col("f.valuation").alias("valuation"), F.col("f.component").alias("component"), F.array_join("f.investors", "+").alias("investors"), "framing")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'model says ' || doc_id ELSE lang END AS summary, doc_id % 5 = 0 AND doc_id % 2 = 0 AS dropped FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 2 = 0)
          UNION ALL SELECT doc_id, NULL, true FROM documents WHERE doc_id % 5 = 0 AND doc_id % 2 = 0""")
def model_summaries(t: Tables):
    """A summary model's answers: what it says, the default where it says nothing, a drop only of borderline items."""
    i = F.col("doc_id")
    answer = F.to_json(F.struct(F.when(i % 3 == 0, F.concat(F.lit("model says "), i.cast("string"))).alias("summary"), F.when(i % 5 == 0, "drop").otherwise("keep").alias("decision")))
    out = models.summarised(answer, i % 2 == 0, F.col("lang"))
    return t.documents.select("doc_id", out["summary"].alias("summary"), out["dropped"].alias("dropped"))


@query("SELECT doc_id, lang = 'de' OR lang = 'fr' OR lang = 'es' AS to_translate FROM documents")
def translation_gate(t: Tables):
    return t.documents.select("doc_id", models.to_translate("lang", F.lit(" EN ")).alias("to_translate"))


_DATES = ("today", "yesterday", "3 days ago", "2 weeks ago", "2024-01-09", "January 8, 2024", "7 Jan 2024", "Tue, 9 Jan 2024 10:00:00 GMT", "soon")
_TITLES = ("A guide to robots", "An automotive deal", "An automotive plant", "The mayor on zoning", "The mayor on zoning permits", "A plain story")
_PACKS = ("industrial_robotics_physical_ai", "housing_delivery_bottlenecks", "other")


def _of(words: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({at}) % {len(words)} + 1]"


@query(f"""SELECT k AS o_orderkey, told_at, CASE WHEN k % 29 = 0 THEN 'already_seen_in_bot_history' WHEN confidence = 'low' THEN 'low_confidence' WHEN told_at IS NULL THEN 'missing_or_unparseable_published_date'
    WHEN told_at < TIMESTAMP '2024-01-08 12:00:00' THEN 'outside_freshness_window' WHEN title = 'A guide to robots' OR k % 13 = 0 THEN 'evergreen_or_report_like_content' WHEN k % 7 = 0 THEN 'low_signal_source_or_partner_content'
    WHEN pack = '{_PACKS[0]}' AND title = 'An automotive deal' THEN 'automotive_or_vehicle_ai_without_factory_deployment' WHEN pack = '{_PACKS[1]}' AND title = 'The mayor on zoning' THEN 'housing_policy_without_delivery_system_signal' END AS reason,
    CASE WHEN k % 11 = 0 THEN 'press_release_rehost' WHEN k % 17 = 0 THEN 'tabloid_verify_better_source' END AS source_quality, CASE WHEN k % 11 = 0 THEN 'verify_primary_source' WHEN confidence = 'high' AND k % 17 <> 0 THEN 'likely_post' ELSE 'watch_only' END AS priority
    FROM (SELECT k, confidence, pack, title, CASE day WHEN 'today' THEN TIMESTAMP '2024-01-10 12:00:00' WHEN 'yesterday' THEN TIMESTAMP '2024-01-09 12:00:00' WHEN '3 days ago' THEN TIMESTAMP '2024-01-07 12:00:00' WHEN '2024-01-09' THEN TIMESTAMP '2024-01-09'
      WHEN 'January 8, 2024' THEN TIMESTAMP '2024-01-08' WHEN '7 Jan 2024' THEN TIMESTAMP '2024-01-07' WHEN '{_DATES[7]}' THEN TIMESTAMP '2024-01-09 10:00:00' END AS told_at
      FROM (SELECT o_orderkey AS k, {_of(('high', 'medium', 'low'), 'o_custkey')} AS confidence, {_of(_PACKS, 'o_orderkey // 3')} AS pack, {_of(_TITLES, 'o_orderkey // 5')} AS title, {_of(_DATES, 'o_orderkey')} AS day FROM orders))""")
def discovery_rejects(t: Tables):
    """Why a found candidate isn't taken, what its source is worth and how soon it is looked at."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))
    found = relational.spread(t.orders).select(
        "o_orderkey", pick(_TITLES, F.floor(k / 5)).alias("title"), F.concat(F.lit("https://n.org/"), F.when(k % 13 == 0, "market-overview-").otherwise(""), k.cast("string")).alias("url"),
        F.concat_ws(", ", F.when(k % 7 == 0, "Sponsored News"), F.when(k % 11 == 0, "Business Wire"), F.when(k % 17 == 0, "Daily Mail")).alias("source_name"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("why_relevant"), F.lit(None).cast("string").alias("matched_signal"),
        pick(_PACKS, F.floor(k / 3)).alias("pack"), pick(("high", "medium", "low"), c).alias("confidence"), pick(_DATES, k).alias("published_date"), (k % 29 == 0).alias("seen"),
    )
    out = discovery.evaluated(found, F.lit("2024-01-10 12:00:00").cast("timestamp"), 2)
    return out.select("o_orderkey", "told_at", "reason", "source_quality", "priority")


@query("""SELECT turn, pack, query FROM (SELECT CAST(i - 1 AS INT) AS turn, n_name AS pack, n_nationkey AS position, n_name || ' ' || (i - 1) AS query FROM nation, range(1, 4) r(i)) ORDER BY turn, position LIMIT 30""")
def discovery_query_plan(t: Tables):
    packs = t.nation.select(F.col("n_name").alias("pack"), F.col("n_nationkey").alias("position"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat("n_name", F.lit(" "), i.cast("string"))).alias("queries"))
    return discovery.query_plan(packs, 30)
