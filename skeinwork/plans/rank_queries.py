"""Queries of representatives, top-k, resolution and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators import rank, resolve, state
from skeinwork.plans.registry import Tables, query
from skeinwork.plans.relational_queries import GATED_SQL
from skeinwork.plans.text_queries import BUCKET_SQL, BUCKETS, FLAGGED_SQL, KEY, TITLE, TOKENS, flagged, gated
from skeinwork.operators.rules import first_match


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t: Tables):
    return rank.best_of(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_MEMBERS = f"SELECT doc_id AS item_id, {KEY} AS canonical_event_id, CASE WHEN lang = 'en' THEN 'direct' ELSE 'other' END AS layer, source = 'src0' AS is_wrapper, n_chars % 3 AS directness_rank, n_chars % 5 AS competitor_count, n_chars % 7 AS source_priority, substr(text, 82, 40) AS text_preview, {TITLE} AS title, doc_id % 2 = 0 AS current FROM documents"
_ORDER = "layer <> 'direct', is_wrapper, directness_rank DESC, competitor_count DESC, source_priority DESC, text_preview <> '' DESC, length(title) DESC, item_id"


def _members(t: Tables):
    title = text.title_of("text")
    return t.documents.select(
        F.col("doc_id").alias("item_id"), text.event_key(title).alias("canonical_event_id"), F.when(F.col("lang") == "en", "direct").otherwise("other").alias("layer"), (F.col("source") == "src0").alias("is_wrapper"),
        (F.col("n_chars") % 3).alias("directness_rank"), (F.col("n_chars") % 5).alias("competitor_count"), (F.col("n_chars") % 7).alias("source_priority"), F.substring("text", 82, 40).alias("text_preview"), title.alias("title"), (F.col("doc_id") % 2 == 0).alias("current"),
    )


@query(f"SELECT canonical_event_id, item_id FROM ({_MEMBERS}) QUALIFY row_number() OVER (PARTITION BY canonical_event_id ORDER BY {_ORDER}) = 1")
def representative(t: Tables):
    return resolve.representatives(_members(t)).select("canonical_event_id", "item_id")


@query(f"SELECT e.canonical_event_id, c.item_id FROM (SELECT DISTINCT canonical_event_id FROM ({_MEMBERS})) e LEFT JOIN (SELECT * FROM ({_MEMBERS}) WHERE current QUALIFY row_number() OVER (PARTITION BY canonical_event_id ORDER BY {_ORDER}) = 1) c USING (canonical_event_id)")
def current_representative(t: Tables):
    m = _members(t)
    return m.select("canonical_event_id").distinct().join(resolve.representatives(m.filter("current")).select("canonical_event_id", "item_id"), "canonical_event_id", "left")


@query(f"SELECT k AS event_key, doc_id, score FROM (SELECT *, {KEY} AS k FROM ({GATED_SQL})) QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) = 1")
def best_per_event(t: Tables):
    df = gated(t).withColumn("event_key", text.event_key(text.title_of("text")))
    return rank.best_of(df, ["event_key"], [F.desc("score"), F.col("doc_id")]).select("event_key", "doc_id", "score")


@query("SELECT p_brand, max(struct_pack(a := p_retailprice, b := p_partkey)).b AS p_partkey FROM part GROUP BY 1")
def best_by_struct(t: Tables):
    return t.part.groupBy("p_brand").agg(F.max(F.struct("p_retailprice", "p_partkey")).alias("m")).select("p_brand", F.col("m.p_partkey").alias("p_partkey"))


@query(f"SELECT doc_id FROM (SELECT doc_id, lang || ':' || {KEY} AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1")
def first_seen(t: Tables):
    key = F.concat_ws(":", "lang", text.event_key(text.title_of("text")))
    return rank.first_seen(t.documents, key, [F.col("doc_id")]).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)")
def first_seen_null_passes(t: Tables):
    return rank.first_seen(t.events, F.when(F.col("event_type") == "click", F.col("user_id")), [F.col("ts"), F.col("event_id")]).select("event_id")


@query(f"SELECT bucket, doc_id FROM (SELECT doc_id, {BUCKET_SQL} AS bucket, length(text) AS n FROM ({FLAGGED_SQL})) WHERE bucket IN ('legal', 'english', 'german', 'french', 'spanish') QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, doc_id) <= 2")
def quota_topk(t: Tables):
    df = flagged(t).withColumn("bucket", first_match([(F.col(f), b) for f, b in BUCKETS], "other"))
    return rank.quota(df, "bucket", ("legal", "english", "german", "french", "spanish"), [F.length("text").desc(), F.col("doc_id")], 2).select("bucket", "doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_topk(t: Tables):
    return rank.top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query(f"SELECT doc_id, bucket, score FROM (SELECT doc_id, {BUCKET_SQL} AS bucket, score FROM ({GATED_SQL}) WHERE reason IS NULL) ORDER BY CASE bucket WHEN 'english' THEN 0 WHEN 'german' THEN 1 ELSE 2 END, score DESC, doc_id LIMIT 6")
def review_queue(t: Tables):
    df = gated(t).filter("status = 'keep'").withColumn("bucket", first_match([(F.col(f), b) for f, b in BUCKETS], "other"))
    priority = F.when(F.col("bucket") == "english", 0).when(F.col("bucket") == "german", 1).otherwise(2)
    return rank.top(df, [priority.asc(), F.desc("score"), F.col("doc_id")], 6).select("doc_id", "bucket", "score")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 40")
def rank_number(t: Tables):
    best = rank.top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 40)
    return best.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


_STAGES = f"SELECT doc_id, score, CASE WHEN insulting THEN 3 WHEN q = 1 AND toxic = 0 THEN 0 WHEN reason IS NULL THEN 1 ELSE 2 END AS stage FROM (SELECT g.*, l.quality AS q, l.toxic FROM ({GATED_SQL}) g LEFT JOIN labels l USING (doc_id))"


@query(f"SELECT doc_id, stage, score FROM ({_STAGES}) WHERE stage < 3 ORDER BY stage, score DESC, doc_id LIMIT 20")
def digest_preparation(t: Tables):
    """Candidates by stage: decided, kept, others as backfill; the first twenty."""
    df = gated(t).join(t.labels, "doc_id", "left")
    stage = F.when(F.col("insulting"), 3).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("status") == "keep", 1).otherwise(2)
    return rank.top(df.withColumn("stage", stage).filter("stage < 3"), [F.col("stage"), F.desc("score"), F.col("doc_id")], 20).select("doc_id", "stage", "score")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) <= 5")
def case_order_limit(t: Tables):
    state_ = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    w = Window.partitionBy("o_orderpriority").orderBy(state_, F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("o_orderpriority", "o_orderkey")


@query()
def tie_window_representative(t: Tables):
    """Of each customer's orders in order of arrival; scores within 5,000 tie."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), (F.col("o_orderpriority") < "3").alias("evidence"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").cast("string").alias("url"))
    told = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return told.select("o_custkey", rank.tie_window_best(F.col("rows"), 5000)["id"].alias("o_orderkey"))


@query(f"""WITH d AS (SELECT source, doc_id, ['t' || {TITLE}, 'k' || {KEY}] AS k FROM documents),
           f AS (SELECT source, list_reduce(list_concat([struct_pack(i := CAST(-1 AS BIGINT), k := CAST([] AS VARCHAR[]), ids := CAST([] AS BIGINT[]))], list(struct_pack(i := doc_id, k := k, ids := CAST([] AS BIGINT[])) ORDER BY doc_id)),
             lambda s, x: CASE WHEN list_has_any(s.k, list_filter(x.k, lambda v: v <> 't')) THEN s ELSE struct_pack(i := s.i, k := list_concat(s.k, list_filter(x.k, lambda v: v <> 't')), ids := list_append(s.ids, x.i)) END) AS s FROM d GROUP BY source)
           SELECT source, unnest(s.ids) AS doc_id FROM f""")
def first_seen_any_key(t: Tables):
    """Within each source: first sight by id, title or event key."""
    df = t.documents.select("source", "doc_id", text.title_of("text").alias("title"))
    return rank.first_seen_any(df, "doc_id", [], [F.col("doc_id"), F.col("title"), text.event_key("title")], [F.col("source")]).select("source", "doc_id")


_TOK = f"SELECT doc_id AS id, list_distinct({TOKENS}) AS tok, {KEY} AS k FROM documents"


@query(f"""WITH d AS MATERIALIZED ({_TOK}), p AS (SELECT x.id AS a, y.id AS b, x.k = y.k AS one_key,
             CASE WHEN least(len(x.tok), len(y.tok)) > 0 THEN len(list_intersect(x.tok, y.tok)) / least(len(x.tok), len(y.tok)) ELSE 0.0 END AS s FROM d x JOIN d y ON x.id < y.id)
           SELECT a, b, round(s, 6) AS similarity FROM p WHERE one_key OR s >= 0.75""")
def title_similarity_pairs(t: Tables):
    """Every pair of titles that are alike, however frequent their tokens."""
    return resolve.similar_pairs(t.documents.select("doc_id", text.title_of("text").alias("title")), "doc_id", "title")


_LINKS = f"SELECT doc_id, md5(text) AS x, source || ':' || {KEY} AS y FROM documents"


@query(f"""WITH RECURSIVE d AS MATERIALIZED ({_LINKS}), n AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.x = b.x AND a.doc_id <> b.doc_id UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.y = b.y AND a.doc_id <> b.doc_id),
          r(node, g) AS (SELECT a, a FROM n UNION SELECT n.b, r.g FROM r JOIN n ON r.node = n.a) SELECT node, min(g) AS "group" FROM r GROUP BY node""")
def duplicate_components(t: Tables):
    """Documents joined by equal texts or by event keys of one source, transitively."""
    key = F.concat_ws(":", "source", text.event_key(text.title_of("text")))
    d = t.documents.select("doc_id", F.explode(F.array(F.md5("text"), key)).alias("k"))
    least = d.groupBy("k").agg(F.min("doc_id").alias("a"))
    return resolve.connected(d.join(least, "k").filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct())


@query()
def event_clusters(t: Tables):
    """Greedy clustering of titles into events."""
    items = t.documents.select("doc_id", text.title_of("text").alias("title"), F.concat(F.lit("doc:"), F.md5("text")).alias("url"), F.lit(None).cast("timestamp").alias("at"))
    return resolve.cluster(items, "doc_id", "title", "url", "at", "doc_id")


@query("SELECT user_id, event_type, count(*) % 2 = 1 AS active, max(ts) AS changed_at FROM events GROUP BY 1, 2")
def toggle_state(t: Tables):
    return state.toggled(t.events, ["user_id", "event_type"], "ts")


@query("SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(t: Tables):
    return state.latest(t.events, ["user_id"], "ts", "event_type", "event_id")


@query("WITH n AS (SELECT o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) = 1), o AS (SELECT o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) = 1) SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n")
def upsert_latest(t: Tables):
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice")
    early = o.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    old = rank.best_of(early, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice")])
    return state.upsert(old, o.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")), ["o_custkey"], "o_orderdate")


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT DISTINCT l_partkey, l_suppkey FROM lineitem x WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_returnflag = 'A' AND y.l_partkey = x.l_partkey AND y.l_suppkey = x.l_suppkey)")
def insert_or_ignore(t: Tables):
    pairs = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return state.insert_or_ignore(pairs.filter("l_returnflag = 'A'").drop("l_returnflag"), pairs.filter("l_returnflag = 'R'").drop("l_returnflag"), ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def replace_group(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return state.replace_group(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'P'").drop("o_orderstatus"), ["o_custkey"])


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'decided_toxic' WHEN first_key < doc_id THEN 'same_event' WHEN first_text < doc_id THEN 'same_text' END AS reason
          FROM (SELECT d.doc_id, l.toxic, min(d.doc_id) OVER (PARTITION BY """ + KEY + """) AS first_key, min(d.doc_id) OVER (PARTITION BY d.text) AS first_text FROM documents d LEFT JOIN labels l USING (doc_id))""")
def suppression_order(t: Tables):
    """Why an item isn't sent: decided, then event, then text, the first that holds."""
    d = t.documents.withColumn("event_key", text.event_key(text.title_of("text"))).withColumn("digest", F.sha2("text", 256))
    d = d.join(d.groupBy("event_key").agg(F.min("doc_id").alias("first_key")), "event_key").join(d.groupBy("digest").agg(F.min("doc_id").alias("first_text")), "digest")
    d = d.join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", first_match([(F.coalesce(F.col("toxic") == 1, F.lit(False)), "decided_toxic"), (F.col("first_key") < F.col("doc_id"), "same_event"), (F.col("first_text") < F.col("doc_id"), "same_text")]).alias("reason"))


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def bounded_history(t: Tables):
    end = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return t.events.filter((F.col("ts") >= end - F.make_interval(hours=F.lit(72))) & (F.col("ts") < end)).select("event_id", "user_id", "ts")


@query("SELECT user_id, max(event_id) + 1 AS next_offset, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def cursors(t: Tables):
    return t.events.filter("event_type = 'click'").groupBy("user_id").agg((F.max("event_id") + 1).alias("next_offset"), F.count("*").alias("n"))


def flagship(t: Tables):
    """Documents, normalised and flagged, scored, gated, without decided ones, one an event, the best 25."""
    df = gated(t).filter("status = 'keep'").join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    df = df.withColumn("event_key", text.event_key(text.title_of("text")))
    best = rank.best_of(df, ["event_key"], [F.desc("score"), F.col("doc_id")])
    return rank.top(best, [F.desc("score"), F.col("doc_id")], 25).select("doc_id", "event_key", "score", F.md5(text.collapse("text")).alias("digest"))


@query(f"SELECT doc_id, event_key, score, md5(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS digest FROM (SELECT *, {KEY} AS event_key FROM ({GATED_SQL}) WHERE reason IS NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY score DESC, doc_id) = 1) ORDER BY score DESC, doc_id LIMIT 25")
def shortlist(t: Tables):
    return flagship(t)
