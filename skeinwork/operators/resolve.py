"""Entity resolution: similar titles, transitive groups, events that keep their identity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import event_key, overlap, tokens
from skeinwork.operators.rank import best_of
from skeinwork.operators.relational import apart
from skeinwork.operators.shared import dropped, stored

SIMILAR = 0.75
#: Within a group of rows that all match, steps lead back by up to 2 ** (SKIPS - 1) places; longer ways take more rounds.
SKIPS = 16
#: Sets of one token that meet in one part, and rows of one title that are listed at once.
PART, CHUNK = 1024, 512


def candidate_pairs(items: DataFrame, item_id: str, title: str, by: str | None = None) -> DataFrame:
    """(a, b), a < b, of items that share a title token, or their whole key; by: only those with one value of this column."""
    base = items.select(F.col(item_id).alias("id"), (F.col(by) if by else F.lit(0)).alias("by"), F.array_distinct(tokens(title)).alias("tokens"), event_key(title).alias("key"))
    keyed = base.select("id", "by", F.explode("tokens").alias("t")).unionByName(base.select("id", "by", F.concat(F.lit("="), F.col("key")).alias("t")))
    return keyed.select("t", "by", F.col("id").alias("a")).join(keyed.select("t", "by", F.col("id").alias("b")), ["t", "by"]).filter("a < b").select("a", "b").distinct()


def _titled(items: DataFrame, title: str) -> DataFrame:
    """items with `tokens` (distinct, sorted) and `key` of a title, read once and stored."""
    read = stored(items.withColumn("_words", tokens(title)).drop(title))
    key = F.array_join(F.slice("_words", 1, 6), "-")
    return read.select("*", F.array_sort(F.array_distinct("_words")).alias("tokens"), F.when(key == "", "untitled").otherwise(key).alias("key")).drop("_words")


def alike(sets: DataFrame) -> DataFrame:
    """a, b (in either order), measure of sets of different groups whose overlap is SIMILAR or more; none is left out.

    sets: id, tokens (distinct), group. Of n tokens, such a set shares ceil(SIMILAR * n) with
    a set as large or larger, so one at least of its n - ceil(SIMILAR * n) + 1 rarest tokens:
    only these propose, to all sets that hold them and aren't smaller. A pair is measured where it
    meets, and counts at the rarest token that both have, so no proposal is ever moved, and a set
    is passed over that has too few tokens from that one on; a token's sets meet in parts of at
    most some PART of them.
    """
    each = stored(sets.select("id", "group", F.explode("tokens").alias("t")))
    counts = each.groupBy("t").agg(F.count("*").alias("count")).filter("count > 1").select("t", F.struct("count", F.monotonically_increasing_id().alias("number")).alias("word"))
    alone = F.struct(F.lit(0).cast("long").alias("count"), F.lit(-1).cast("long").alias("number"))
    # A token that no other set has counts in the set's size, and in its rarest ones.
    words = each.join(stored(counts).hint("merge"), "t", "left").groupBy("id", "group").agg(F.array_sort(F.collect_list(F.coalesce("word", alone))).alias("words"))
    words = stored(words).select("id", "group", F.size("words").alias("n"), F.transform(F.filter("words", lambda w: w["count"] > 0), lambda w: w["number"]).alias("held"), F.posexplode("words").alias("place", "word")).filter("word.count > 0")
    parts = F.ceil(F.col("word.count") / PART).cast("int")
    need = F.ceil(F.lit(SIMILAR) * F.col("n")).cast("int")
    few = words.filter(F.col("place") < F.col("n") - need + 1)
    left = few.select(F.col("word.number").alias("t"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("a"), F.col("n").alias("p"), need.alias("need"), F.col("group").alias("g"), F.col("held").alias("x"))
    right = words.select(F.col("word.number").alias("t"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("b"), F.col("n").alias("q"), (F.col("n") - F.col("place")).alias("left"), F.col("group").alias("h"), F.col("held").alias("y"))
    # A number of parts that is asked for stays: rows are few here, but their pairs are the work.
    dealt = lambda df: df.repartition(8 * sets.sparkSession.sparkContext.defaultParallelism, "t", "part")
    both = dealt(left).join(dealt(right).hint("merge"), ["t", "part"]).filter("g <> h and (p < q or (p = q and a < b)) and left >= need")
    shared = F.array_intersect("x", "y")  # compiled as it stands; within a lambda it wouldn't be
    return both.filter((F.size(shared) >= F.col("need")) & (shared[0] == F.col("t"))).select("a", "b", (F.size(shared) / F.col("p")).alias("measure"))


def similar_pairs(items: DataFrame, item_id: str, title: str, at: str | None = None, days: int = 10) -> DataFrame:
    """a, b, similarity of the pairs that tell of one event; none is left out.

    Titles of one key and one set of tokens are measured once. Their rows are listed as pairs only
    at the end, chunk by chunk, so that no task lists more than CHUNK times CHUNK pairs of two chunks.
    Rows without an id, or of one id, make no pair.
    """
    side = _titled(items.select(F.col(item_id).alias("id"), (F.col(at) if at else F.lit(None).cast("timestamp")).alias("at"), F.col(title).alias("title")), "title")
    kinds = stored(side.groupBy("key", "tokens").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()))
    l, r = (kinds.select("key", F.col("number").alias(i), F.col("tokens").alias(v)) for i, v in (("a", "x"), ("b", "y")))  # noqa: E741
    keyed = l.join(r, "key").filter("a < b").select("a", "b", overlap(F.col("x"), F.col("y")).alias("measure")).filter(F.col("measure") < SIMILAR)
    own = kinds.filter("n > 1").select(F.col("number").alias("a"), F.col("number").alias("b"), F.when(F.size("tokens") > 0, 1.0).otherwise(0.0).alias("measure"))
    pairs = stored(alike(kinds.select(F.col("number").alias("id"), "tokens", F.col("number").alias("group"))).unionByName(keyed).unionByName(own))

    members = side.select("id", "at", "key", "tokens").filter("id is not null").join(kinds, ["key", "tokens"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("int"))
    row = F.struct("id", "at") if at else F.col("id")
    of = lambda c: F.col(f"{c}.id" if at else c)
    chunks = stored(members.groupBy("number", "part").agg(F.collect_list(row).alias("rows")))
    x, y = (chunks.select(F.col("number").alias(i), F.col("part").alias(p), F.col("rows").alias(v)) for i, p, v in (("a", "p", "x"), ("b", "q", "y")))
    met = pairs.join(x, "a").join(y, "b").filter("a <> b or p <= q").repartition(8 * items.sparkSession.sparkContext.defaultParallelism, "a", "p", "b", "q")
    listed = met.select(((F.col("a") == F.col("b")) & (F.col("p") == F.col("q"))).alias("one"), F.round("measure", 6).alias("similarity"), "y", F.explode("x").alias("x")).select("one", "similarity", "x", F.explode("y").alias("y"))
    near = _near(F.col("x.at"), F.col("y.at"), days) if at else F.lit(True)
    return listed.filter(((of("x") < of("y")) | (~F.col("one") & (of("x") > of("y")))) & near).select(F.least(of("x"), of("y")).alias("a"), F.greatest(of("x"), of("y")).alias("b"), "similarity")


def _near(x: Column, y: Column, days: int = 10) -> Column:
    return F.coalesce(F.abs(F.unix_timestamp(x) - F.unix_timestamp(y)) <= days * 86400, F.lit(True))


def least_reached(steps: DataFrame) -> DataFrame:
    """node, label (the smallest node that steps a -> b reach from it, or itself), until none changes.

    Each round a node takes the smallest label of where its steps lead, then the label of that
    label, so chains shorten by half and more. Labels only fall, so the rounds come to an end.
    """
    steps = stored(steps.select("a", "b").distinct())
    nodes = steps.select(F.col("a").alias("node"), F.least("a", "b").alias("label")).unionByName(steps.select(F.col("b").alias("node"), F.col("b").alias("label")))
    labels = stored(nodes.groupBy("node").agg(F.min("label").alias("label")))
    while True:
        labels = apart(labels)
        near = steps.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        step = stored(step.join(jump, "next").select("node", F.least("next", "beyond").alias("label"), "was"))
        dropped(labels)
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels


def connected(edges: DataFrame) -> DataFrame:
    """node, group (its smallest member) from edges (a, b): labels spread until none changes."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    return least_reached(both).withColumnRenamed("label", "group")


def representative_order(prefix: str = "") -> list[Column]:
    """Who speaks for an event: direct, not a wrapper, direct rank, competitors, priority, with a preview, longer title, id."""
    c = lambda name: F.col(prefix + name)
    return [
        (c("layer") != "direct").asc(), c("is_wrapper").asc(), c("directness_rank").desc(), c("competitor_count").desc(),
        c("source_priority").desc(), F.coalesce(c("text_preview") != "", F.lit(False)).desc(), F.length(c("title")).desc(), c("item_id").asc(),
    ]


def representatives(members: DataFrame) -> DataFrame:
    """One row per canonical_event_id: the member that speaks for it."""
    return best_of(members, ["canonical_event_id"], representative_order())


def fold_clusters(rows: pd.DataFrame) -> pd.DataFrame:
    """Cluster of each row, greedily in order: a row joins the first cluster that has a
    matching row. rows: id, order, url, at, tokens, key. What cluster() does, in one task."""
    from datetime import timedelta

    def same(a: dict, b: dict) -> bool:
        if a["url"] == b["url"]:
            return True
        if pd.notna(a["at"]) and pd.notna(b["at"]) and abs(a["at"] - b["at"]) > timedelta(days=10):
            return False
        x, y = set(a["tokens"]), set(b["tokens"])
        return a["key"] == b["key"] or (bool(x and y) and len(x & y) / min(len(x), len(y)) >= SIMILAR)

    clusters: list[list[dict]] = []
    for row in rows.sort_values("order").to_dict("records"):
        home = next((c for c in clusters if any(same(row, other) for other in c)), None)
        home.append(row) if home is not None else clusters.append([row])
    return pd.DataFrame([{"id": r["id"], "cluster": c[0]["id"]} for c in clusters for r in c])


def _earlier(rows: DataFrame, *by: str, skips: int = 1) -> DataFrame:
    """Steps (a, b) from each row to the one before it among rows with the same `by`, and to those 2, 4, ... places before; rows: node and `by`."""
    w = Window.partitionBy(*by).orderBy("node")
    before = F.array(*[F.lag("node", 1 << i).over(w) for i in range(skips)])
    return rows.select(F.col("node").alias("a"), before.alias("b")).select("a", F.explode("b").alias("b")).filter("b is not null")


def cluster(items: DataFrame, item_id: str, title: str, url: str, at: str, order: str) -> DataFrame:
    """id, cluster: the greedy clustering of fold_clusters over all rows, without a fold.

    A row joins the first of its earlier matches' clusters, which bears the name of its first
    row; so its cluster is the smallest row that steps from matches to earlier matches reach.
    Rows of one (key, at), of one url and of one set of tokens match each other. Where all of
    two such groups match, steps lead from a row to the row before it in its own group, from each
    row of the smaller group to the one before it in the other, and to it from the one after it,
    as the others follow: no pairs of rows are listed, and a group's rows aren't read once a pair.
    """
    base = _titled(items.select(F.col(item_id).alias("id"), F.col(order).alias("order"), F.col(url).alias("url"), F.col(at).alias("at"), F.col(title).alias("title")), "title")
    group = F.sha2(F.concat_ws("|", "key", F.coalesce(F.col("at").cast("string"), F.lit(""))), 256)
    base = base.withColumn("group", group).withColumn("kind", F.sha2(F.concat_ws("|", "group", F.array_join("tokens", " ")), 256))
    base = stored(base)
    first = lambda c: F.first(c).alias(c)
    # Numbers in place of digests from here on: most of what is moved are pairs of them.
    keyed = apart(stored(base.groupBy("group").agg(first("key"), first("at"), F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id())))
    kinds = base.groupBy("kind").agg(first("tokens"), first("group"), first("at"), F.count("*").alias("n")).join(keyed.select("group", "number"), "group")
    kinds = apart(stored(kinds.select(F.monotonically_increasing_id().alias("id"), "kind", "tokens", F.col("number").alias("group"), "at", "n")))
    base = base.select("id", "order", "url", "kind").join(kinds.select("kind", "group", F.col("id").alias("number")), "kind").select("id", "order", "url", "group", F.col("number").alias("kind"))
    # Rows are told by their place in order, a number too: labels are what the rounds send about.
    base = apart(stored(base.repartitionByRange("order", "id").sortWithinPartitions("order", "id").withColumn("node", F.monotonically_increasing_id())))

    def asked(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """few, many: the groups of each pair whose times are near, the smaller one first; of: id, at, n."""
        x, y = (of.select(F.col("id").alias(i), F.struct("n", "id", "at").alias(v)) for i, v in (("a", "x"), ("b", "y")))
        near = pairs.join(x, "a").join(y, "b").filter(_near(F.col("x.at"), F.col("y.at")))
        return near.select(F.least("x", "y")["id"].alias("few"), F.greatest("x", "y")["id"].alias("many"))

    l, r = (keyed.select("key", F.col("number").alias(i)) for i in "ab")  # noqa: E741
    same = asked(l.join(r, "key").filter("a < b"), keyed.select(F.col("number").alias("id"), "at", "n"))

    def between(pairs: DataFrame, name: str) -> DataFrame:
        """Steps between the rows of the groups of each pair: each row of the smaller one and its neighbours in the other."""
        rows = base.select(F.col(name).alias("many"), "node", F.col("node").alias("own"))
        looks = pairs.join(base.select(F.col(name).alias("few"), "node"), "few").select("many", "node", F.lit(None).cast(base.schema["node"].dataType).alias("own"))
        w = lambda by: Window.partitionBy("many").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        told = rows.unionByName(looks).withColumns({"before": F.last("own", True).over(w(F.asc("node"))), "after": F.last("own", True).over(w(F.desc("node")))}).filter("own is null")
        ends = F.array(F.struct(F.col("node").alias("a"), F.col("before").alias("b")), F.struct(F.col("after").alias("a"), F.col("node").alias("b")))
        return told.select(F.explode(ends).alias("s")).select("s.a", "s.b").filter("a is not null and b is not null")

    steps = _earlier(base, "group", skips=SKIPS).unionByName(_earlier(base.filter("url is not null"), "url", skips=SKIPS)).unionByName(between(asked(alike(kinds).select("a", "b"), kinds), "kind")).unionByName(between(same, "group"))
    reached = base.select("id", "node").join(least_reached(steps), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return reached.join(base.select(F.col("node").alias("label"), F.col("id").alias("cluster")), "label").select("id", "cluster")


def event_ids(current: DataFrame, history: DataFrame) -> DataFrame:
    """id, cluster, event_id, known of current rows: a cluster takes the id of the event that history tells.

    current: id, title, url, at, order; history: the same and event_id, which may be null: such a row
    is an event of its own that has no id yet. Current rows are clustered among themselves. A cluster
    matches an event if any of their rows do; of several events it takes the one whose first row
    comes first, and clusters that take one event become one. A new id follows from the history's
    row that was matched, else from the cluster's first row; known: the id is history's.
    """
    clusters = cluster(current, "id", "title", "url", "at", "order")
    row = F.col("id").cast("string")
    home = F.struct(F.col("event_id").cast("string").alias("event"), F.when(F.col("event_id").isNull(), row).alias("row"))
    past = history.select("title", "url", "at", home.alias("home"), F.struct("order", row.alias("id")).alias("told"))
    past = past.join(past.groupBy("home").agg(F.min("told").alias("first")), "home").select("title", "url", "at", F.struct("first", "home").alias("m"))
    now, then = _titled(current.select("id", "url", "at", "title"), "title"), _titled(past, "title")

    # Rows of one title and time match alike: of history's ones the event that comes first counts.
    kinds = now.groupBy("tokens", "key", "at").agg(F.lit(None).cast(then.schema["m"].dataType).alias("m")).withColumn("group", F.lit("now"))
    kinds = stored(kinds.unionByName(then.groupBy("tokens", "key", "at").agg(F.min("m").alias("m")).withColumn("group", F.lit("then"))).withColumn("id", F.monotonically_increasing_id()))
    of = lambda side, i, v: kinds.filter(F.col("group") == side).select(F.col("id").alias(i), F.struct("at", "key", "m").alias(v))
    near = _near(F.col("x.at"), F.col("y.at"))
    pairs = alike(kinds).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    met = pairs.join(of("now", "a", "x"), "a").join(of("then", "b", "y"), "b").filter(near).select("a", "y.m")
    keyed = of("now", "a", "x").join(of("then", "b", "y"), F.col("x.key") == F.col("y.key")).filter(near).select("a", "y.m")
    best = met.unionByName(keyed).groupBy("a").agg(F.min("m").alias("m"))
    best = kinds.filter("group = 'now'").join(best, F.col("id") == F.col("a")).select("tokens", "key", "at", best["m"])
    by_title = now.join(best, (now["tokens"] == best["tokens"]) & (now["key"] == best["key"]) & now["at"].eqNullSafe(best["at"])).select("id", best["m"])
    by_url = now.select("id", "url").join(then.groupBy("url").agg(F.min("m").alias("m")), "url").select("id", "m")
    named = clusters.join(by_title.unionByName(by_url), "id").groupBy("cluster").agg(F.min("m").alias("m")).select("cluster", F.col("m.home").alias("_home"))
    new = F.sha2(F.when(F.col("_home.row").isNotNull(), F.concat(F.lit("history:"), "_home.row")).otherwise(F.concat(F.lit("event:"), F.col("cluster").cast("string"))), 256)
    return clusters.join(named, "cluster", "left").select("id", "cluster", F.coalesce("_home.event", new).alias("event_id"), F.col("_home.event").isNotNull().alias("known"))
