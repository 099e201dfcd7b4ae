"""Queries of joins, set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import audit, relational as rel
from skeinwork.plans.registry import Tables, query
from skeinwork.plans.text_queries import FLAGGED_SQL, GATE_SQL, NAMES, SCORE_SQL, gated

GATED_SQL = f"SELECT *, {GATE_SQL} AS reason FROM (SELECT *, {SCORE_SQL} AS score, length(text) AS n FROM ({FLAGGED_SQL}))"


@query("SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NULL AS undecided FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_decisions(t: Tables):
    out = t.documents.select("doc_id", "source").join(t.labels.withColumn("decided", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", "source", "quality", "toxic", F.col("decided").isNull().alias("undecided"))


@query("SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def inner_chain(t: Tables):
    df = t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(rel.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH g AS (SELECT l_orderkey, count(*) AS lines, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) SELECT o_orderkey, lines, last_ship FROM orders JOIN g ON o_orderkey = l_orderkey WHERE lines >= 5")
def aggregate_join_back(t: Tables):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last_ship")).filter("lines >= 5")
    return t.orders.join(g, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines", "last_ship")


@query("""SELECT o.o_orderkey, coalesce(a.c_name, b.s_name, r.r_name) AS name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) a ON o.o_custkey = a.c_custkey
          LEFT JOIN supplier b ON o.o_custkey % 100 = b.s_suppkey LEFT JOIN region r ON o.o_orderkey % 5 = r.r_regionkey""")
def multi_path_coalesce_join(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 100).alias("k2"), (F.col("o_orderkey") % 5).alias("k3"))
    paths = [(t.customer.filter("c_acctbal > 5000").withColumnRenamed("c_name", "name"), "o_custkey", "c_custkey"), (t.supplier.withColumnRenamed("s_name", "name"), "k2", "s_suppkey"), (t.region.withColumnRenamed("r_name", "name"), "k3", "r_regionkey")]
    return rel.coalesced_left(orders, paths, "name").select("o_orderkey", "name")


@query("SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant'")
def compound_key_join(t: Tables):
    a = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    b = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return a.join(b, ["conv_id", "turn"])


@query("SELECT p.p_partkey, count(l.l_orderkey) AS n FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey AND p.p_size > 25 AND l.l_returnflag = 'R' GROUP BY 1")
def conditional_left_join(t: Tables):
    n = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("k"))
    return t.part.join(n, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") > 25), "left").select("p_partkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def or_key_match(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    return rel.matched_by_any(lines, t.part.filter("p_size = 7"), ["l_partkey", "l_suppkey"], "p_partkey", "row").select("l_orderkey", "l_linenumber").distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def already_seen_anti(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS seen FROM documents d")
def already_seen_flag(t: Tables):
    return rel.seen_flag(t.documents.select("doc_id"), t.labels.filter("toxic = 1"), "doc_id")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 3 * 86400 AND a.value > b.value")
def interval_match(t: Tables):
    a, b = t.events.filter("event_type = 'signup'"), t.events.filter("event_type = 'purchase'")
    out = rel.interval_match(a, b, "user_id", "ts", 3, F.col("l.value") > F.col("r.value"))
    return out.select(F.col("l.event_id").alias("left_id"), F.col("r.event_id").alias("right_id"))


@query("""SELECT left_id, right_id FROM (SELECT a.event_id AS left_id, b.event_id AS right_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS r
          FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view' AND abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 7 * 86400) WHERE r = 1""")
def interval_first_match(t: Tables):
    a, b = t.events.filter("event_type = 'error'"), t.events.filter("event_type = 'view'")
    out = rel.interval_match(a, b, "user_id", "ts", 7).groupBy(F.col("l.event_id").alias("left_id")).agg(F.max(F.struct("r.ts", "r.event_id")).alias("m"))
    return out.select("left_id", F.col("m.event_id").alias("right_id"))


@query("""WITH h AS (SELECT user_id, ts FROM events WHERE event_type = 'click' AND value > 20 UNION SELECT user_id, ts FROM events WHERE event_type = 'view' AND value > 20)
          SELECT e.event_id, count(*) AS n FROM events e JOIN h ON e.user_id = h.user_id AND abs(epoch_us(e.ts) // 1000000 - epoch_us(h.ts) // 1000000) <= 3 * 86400 WHERE e.event_type = 'signup' GROUP BY 1""")
def interval_match_union(t: Tables):
    e = t.events
    h = e.filter("event_type = 'click' and value > 20").select("user_id", "ts").union(e.filter("event_type = 'view' and value > 20").select("user_id", "ts")).distinct()
    return rel.interval_match(e.filter("event_type = 'signup'"), h, "user_id", "ts", 3).groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS a, 0 AS p FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 2 FROM orders WHERE o_orderstatus = 'F')
          SELECT c_custkey, v AS o_orderkey, CAST(p AS INT) AS source_rank FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, a DESC, v DESC) AS r FROM s) x ON c_custkey = k AND r = 1""")
def priority_lookup(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    sources = [o.filter(F.col("o_orderstatus") == s) for s in "POF"]
    return rel.priority_lookup(t.customer.select("c_custkey"), "c_custkey", sources, "o_orderkey", "o_orderdate")


_NORM = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"
_ALIASES = "SELECT DISTINCT 'bench-' || item_id AS name, array_to_string(list_slice(string_split(" + _NORM.format("text") + ", ' '), 1, n), ' ') AS alias FROM benchmark, (VALUES (2), (3)) v(n)"


def _aliases(t: Tables):
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return t.benchmark.select(F.concat(F.lit("bench-"), "item_id").alias("name"), F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 1, 3), " "))).alias("alias")).distinct()


@query(f"SELECT DISTINCT doc_id, name, alias, field FROM (SELECT doc_id, 'text' AS field, ' ' || {_NORM.format('text')} || ' ' AS h FROM documents UNION ALL SELECT doc_id, 'source', ' ' || {_NORM.format('source')} || ' ' FROM documents), ({_ALIASES}) WHERE contains(h, ' ' || alias || ' ')")
def alias_matches(t: Tables):
    return rel.aliases_in(t.documents, "doc_id", ["text", "source"], rel.small(_aliases(t)))


@query(f"SELECT doc_id, count(DISTINCT name) AS n FROM (SELECT doc_id, ' ' || {_NORM.format('text')} || ' ' AS h FROM documents), ({_ALIASES}) WHERE contains(h, ' ' || alias || ' ') GROUP BY 1")
def alias_match_count(t: Tables):
    return rel.aliases_in(t.documents, "doc_id", ["text"], rel.small(_aliases(t))).groupBy("doc_id").agg(F.countDistinct("name").alias("n"))


@query("SELECT k AS part_key, max(l_orderkey) AS best_order FROM (SELECT l_partkey AS k, l_orderkey FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem) WHERE k IN (SELECT p_partkey FROM part WHERE p_size <= 3) GROUP BY 1")
def allow_list_join(t: Tables):
    keys = t.lineitem.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("part_key"), "l_orderkey")
    allowed = t.part.filter("p_size <= 3").select(F.col("p_partkey").alias("part_key"))
    return keys.join(allowed, "part_key", "left_semi").groupBy("part_key").agg(F.max("l_orderkey").alias("best_order"))


@query("SELECT p_partkey, p_name, s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey WHERE p_partkey IN (1, 5, 9, 100, 99999)")
def point_lookup(t: Tables):
    return t.part.filter(F.col("p_partkey").isin(1, 5, 9, 100, 99999)).join(t.supplier, F.col("p_partkey") == F.col("s_suppkey"), "left").select("p_partkey", "p_name", "s_name")


@query("SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND source ILIKE '%C1%' OR toxic = 0 AND source ILIKE 'SRC7' ORDER BY quality DESC, source, doc_id LIMIT 40")
def signals_join_limited(t: Tables):
    df = t.documents.select("doc_id", "source").join(t.labels.filter("toxic = 0"), "doc_id").filter(F.col("source").ilike("%C1%") | F.col("source").ilike("SRC7"))
    return df.select("doc_id", "source", "quality").orderBy(F.desc("quality"), "source", "doc_id").limit(40)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority LIKE '1-%' AND o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def dynamic_where(t: Tables):
    df = t.orders.filter(F.col("o_orderpriority").startswith("1-"))
    for column, value in {"o_orderstatus": "O"}.items():
        df = df.filter(F.col(column) == value)
    return df.filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-06-30 23:59:59.999999").cast("timestamp"))).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant' OR regexp_matches(text, '[?]')")
def message_filter(t: Tables):
    return t.conversations.filter((F.col("role") == "assistant") | F.contains(F.col("text"), F.lit("?"))).select("conv_id", "turn", "role")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 UNION SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1")
def union_distinct_paths(t: Tables):
    a = t.orders.filter("o_totalprice > 200000").join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    b = t.lineitem.join(t.part.filter("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey")
    return a.union(b).distinct()


@query("SELECT doc_id, min(p) AS priority FROM (SELECT doc_id, 0 AS p FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE n_chars > 5000) GROUP BY 1")
def priority_concat(t: Tables):
    parts = [t.labels.filter("toxic = 1").select("doc_id"), t.labels.filter("quality = 0").select("doc_id"), t.documents.filter("n_chars > 5000").select("doc_id")]
    all_ = parts[0].withColumn("p", F.lit(0)).unionByName(parts[1].withColumn("p", F.lit(1))).unionByName(parts[2].withColumn("p", F.lit(2)))
    return all_.groupBy("doc_id").agg(F.min("p").alias("priority"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_difference(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT user_id, array_to_string(list_sort(list_intersect(list_distinct(list(event_type)), ['click', 'purchase', 'refund'])), ',') AS allowed FROM events WHERE value > 30 GROUP BY 1")
def key_algebra(t: Tables):
    kinds = F.collect_set("event_type")
    allowed = F.array_intersect(F.array_union(kinds, F.array().cast("array<string>")), F.array(*map(F.lit, ("click", "purchase", "refund"))))
    return t.events.filter("value > 30").groupBy("user_id").agg(F.array_join(F.array_sort(allowed), ",").alias("allowed"))


@query("SELECT doc_id, 'shortlist' AS path FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT doc_id, 'promoted' FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def promoted_union(t: Tables):
    short = t.labels.filter("quality = 1 and toxic = 0").select("doc_id")
    more = t.documents.filter("n_chars > 3000").select("doc_id").join(short, "doc_id", "left_anti")
    return short.withColumn("path", F.lit("shortlist")).union(more.withColumn("path", F.lit("promoted")))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 10")
def reaction_threshold(t: Tables):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"), F.max("ts").alias("last_ts")).filter("users >= 10")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def unambiguous_key(t: Tables):
    return rel.unambiguous(t.orders, "o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT coalesce(nullif(CAST(user_id % 7 AS VARCHAR), '0'), event_type) AS k, max(ts) AS last_ts, max(event_id) AS last_id, min(ts) AS first_ts FROM events GROUP BY 1")
def max_per_coalesced(t: Tables):
    k = F.coalesce(F.nullif((F.col("user_id") % 7).cast("string"), F.lit("0")), F.col("event_type"))
    return t.events.groupBy(k.alias("k")).agg(F.max("ts").alias("last_ts"), F.max("event_id").alias("last_id"), F.min("ts").alias("first_ts"))


@query(f"SELECT name, n FROM (SELECT count(*) AS collected, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'insult') AS insulted, count(*) FILTER (score > 20) AS high FROM ({GATED_SQL})) UNPIVOT (n FOR name IN (collected, kept, insulted, high))")
def run_counters(t: Tables):
    return audit.counters(gated(t), {"collected": F.lit(True), "kept": F.col("status") == "keep", "insulted": F.col("reason") == "insult", "high": F.col("score") > 20})


@query(f"SELECT reason, count(*) AS n FROM ({GATED_SQL}) WHERE reason IS NOT NULL GROUP BY 1")
def skip_reason_counts(t: Tables):
    return audit.counted(gated(t).filter("reason is not null"), "reason")


@query(f"SELECT v.reason, count(g.doc_id) AS n FROM (VALUES ('insult'), ('duplicate'), ('licence_only')) v(reason) LEFT JOIN ({GATED_SQL}) g ON g.reason = v.reason GROUP BY 1")
def zero_filled_counts(t: Tables):
    return rel.zero_filled(gated(t), "reason", ("insult", "duplicate", "licence_only"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(t: Tables):
    return audit.counted(t.part.select(F.explode(F.split("p_name", " ")).alias("tag")), "tag", 10)


@query(f"SELECT source, count(*) AS collected, count(*) FILTER (reason IS NULL) AS kept, round(avg(score), 6) AS mean_score, max(length(text)) AS longest FROM ({GATED_SQL}) GROUP BY 1")
def per_source_counts(t: Tables):
    return gated(t).groupBy("source").agg(F.count("*").alias("collected"), F.count_if(F.col("status") == "keep").alias("kept"), F.round(F.avg("score"), 6).alias("mean_score"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"SELECT doc_id, reason, score FROM ({GATED_SQL}) WHERE reason IS NOT NULL ORDER BY score DESC, doc_id LIMIT 40")
def best_rejected(t: Tables):
    return gated(t).filter("reason is not null").select("doc_id", "reason", "score").orderBy(F.desc("score"), "doc_id").limit(40)


@query("SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_linenumber), '-') AS members FROM lineitem GROUP BY 1")
def cluster_members(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")), "-").alias("members"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def json_signal_extract(t: Tables):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return t.events.select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (value > 10) AS large, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def run_counts(t: Tables):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("large"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def weighted_sums(t: Tables):
    df = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


assert NAMES


@query("""WITH x AS (SELECT * FROM events WHERE event_type <> 'purchase'), y AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase')
          SELECT x.event_id, max(struct_pack(ts := y.ts, id := y.event_id)).id AS newest_id, max(struct_pack(ts := y.ts, id := y.event_id, v := y.value)).v AS newest_value
          FROM x LEFT JOIN y ON x.user_id = y.user_id AND y.ts <= x.ts GROUP BY x.event_id""")
def newest_before(t: Tables):
    """Each event with its user's newest purchase before it."""
    x, y = t.events.filter("event_type <> 'purchase'"), t.events.filter("event_type = 'purchase'")
    return rel.newest_before(x, y, "user_id", "ts", "event_id", days=3).select("event_id", F.col("newest.event_id").alias("newest_id"), F.col("newest.value").alias("newest_value"))
