"""Repeats against what has been sent, and within a run."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skeinwork.functions import extract
from skeinwork.functions.text import story_text
from skeinwork.operators.rank import best_of, first_unlinked
from skeinwork.operators.relational import interval_match, spread
from skeinwork.operators.resolve import connected
from skeinwork.operators.shared import stored

#: Why an item isn't sent, first that holds. A group's deployment probe counts as well as its funding probe.
REASONS = ("event_sent", "url_sent", "group_url", "deployment_sent", "group_deployment", "group_funding", "funding_sent")


def keyed(items: DataFrame, title: str, preview: str, at: str, kinds: Sequence[str] = ("funding", "deployment")) -> DataFrame:
    """items with keys of these kinds, computed once and stored: several probes read them."""
    reads = {"funding": extract.funding_key, "deployment": extract.deployment_key}
    return stored(spread(items).withColumns({kind: reads[kind](title, preview, at) for kind in kinds}))


def _matches(items: DataFrame, history: DataFrame, kind: str, days: int, same) -> DataFrame:
    """item_id, place of items that tell of one event with a row of history; both have key, id and at, history has place."""
    names = F.array(F.col(f"{kind}.entity"))
    if kind == "deployment":  # any of its names: those of two that match have one in common
        names = F.concat(names, F.coalesce(F.col(f"{kind}.pair"), F.array().cast("array<string>")))
    side = lambda df, *more: df.filter(F.col(kind).isNotNull()).select(*more, "at", kind, F.explode(F.array_distinct(F.array_compact(names))).alias("on"))
    both = interval_match(side(items, "item_id"), side(history, "place"), "on", "at", days + 1)
    return both.filter(same(F.col(f"l.{kind}"), F.col(f"r.{kind}"), days)).select(F.col("l.item_id").alias("item_id"), F.col("r.place").alias("place"))


def suppressed(items: DataFrame, sent: DataFrame, shared: DataFrame) -> DataFrame:
    """item_id, reason (null: may go out).

    items, sent, shared: item_id, event_id, url, at, funding, deployment; sent are delivered
    alerts, shared are posts of the group. Probes of one key are one equi join, whichever side they
    look at; the reasons are then read in their order.
    """
    told = lambda key, of_sent, of_shared: sent.select(*key, F.lit(REASONS.index(of_sent)).alias("place")).unionByName(shared.select(*key, F.lit(REASONS.index(of_shared)).alias("place")))
    urls = told(["url"], "url_sent", "group_url").groupBy("url").agg(F.min("place").alias("place"))
    event = items.join(sent.filter("event_id is not null").select("event_id").distinct(), "event_id", "left_semi").select("item_id", F.lit(REASONS.index("event_sent")).alias("place"))
    found = event.unionByName(items.select("item_id", "url").join(urls, "url").select("item_id", "place"))
    found = found.unionByName(_matches(items, told(["at", "deployment"], "deployment_sent", "group_deployment"), "deployment", 7, extract.same_deployment))
    found = found.unionByName(_matches(items, told(["at", "funding"], "funding_sent", "group_funding"), "funding", 3, extract.same_funding))
    first = found.groupBy("item_id").agg(F.min("place").alias("place"))
    names = F.array(*map(F.lit, REASONS))
    return items.select("item_id").join(first, "item_id", "left").select("item_id", F.when(F.col("place").isNotNull(), names[F.col("place")]).alias("reason"))


#: Why items of a run are one story; the first of these that any of its pairs has names the group.
RUN_REASONS = ("funding", "partnership", "launch")


def same_run_pairs(items: DataFrame) -> DataFrame:
    """a, b, reason of a run's items that tell of one funding, partnership or launch within three days.

    items: item_id, at, funding (as extract.run_funding has it), partners (pair), launch (struct
    of company and product). Fundings meet by entity and amount, or by entity and round.
    """
    f = F.col("funding")
    money, backed = F.struct(f["amount"]["currency"], f["amount"]["value"], f["amount"]["scale"]).cast("string"), F.size(f["investors"]) > 0
    keys = (
        (f["amount"].isNotNull(), F.concat_ws("|", F.lit("f"), f["entity"], money), 0), (f["round"].isNotNull() & backed, F.concat_ws("|", F.lit("r"), f["entity"], f["round"]), 0),
        (F.col("partners").isNotNull(), F.concat_ws("|", F.lit("p"), F.array_join("partners", "+")), 1), (F.col("launch").isNotNull(), F.concat_ws("|", F.lit("l"), "launch.company", "launch.product"), 2),
    )
    rows = None
    for given, key, place in keys:
        one = items.filter(given).select("item_id", "at", "funding", key.alias("key"), F.lit(place).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    rows = stored(rows)
    near = F.abs(F.datediff("l.at", "r.at")) <= 3
    told = (F.col("l.place") > 0) | extract.same_run_funding(F.col("l.funding"), F.col("r.funding"))
    pairs = interval_match(rows, rows, "key", "at", 4).filter(near & told & (F.col("l.item_id") < F.col("r.item_id")))
    return pairs.groupBy(F.col("l.item_id").alias("a"), F.col("r.item_id").alias("b")).agg(F.min("l.place").alias("place"))


def same_run_groups(items: DataFrame) -> DataFrame:
    """node, group, reason of a run's items that tell of one story, transitively; the reason is that of the group's first pair."""
    pairs = stored(same_run_pairs(items))
    nodes = connected(pairs)
    first = pairs.join(nodes, F.col("a") == F.col("node")).groupBy("group").agg(F.min(F.struct("a", "b", "place")).alias("first"))
    names = F.array(*map(F.lit, RUN_REASONS))
    return nodes.join(first, "group").select("node", "group", names[F.col("first.place")].alias("reason"))


def repeated_angles(items: DataFrame, recent: DataFrame) -> DataFrame:
    """item_id, representative of the items that tell a company's story of one angle again.

    items, recent: item_id, key (struct of company and angle, or null), score, at, url; of recent
    ones the best speaks for its key.
    """
    best = best_of(recent.filter("key is not null"), ["key"], [F.desc("score"), F.desc("at"), F.col("url"), F.col("item_id")])
    return items.filter("key is not null").join(best.select("key", F.col("item_id").alias("representative")), "key").select("item_id", "representative")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def signature(title: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]+|_", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: F.length(w) > 2), " ")


#: Words that carry no story identity, and words of which one tells a story that shares four.
STORY_STOP_WORDS = (
    "about", "across", "after", "again", "also", "amid", "and", "are", "around", "build", "building", "builds", "can", "city", "construction", "could", "deliver", "delivery", "from", "has", "have", "housing", "into", "its", "more",
    "new", "news", "old", "plan", "push", "says", "the", "their", "this", "through", "toward", "with",
)
STORY_MARKERS = ("mamdani", "zoning", "rezoning", "affordable", "nyc", "code", "codes")


def near_duplicate_pairs(candidates: DataFrame, pairs: DataFrame, ratio: float = 0.78, related: Sequence[tuple[str, str]] = (), markers: Sequence[str] = STORY_MARKERS, stop_words: Sequence[str] = STORY_STOP_WORDS) -> DataFrame:
    """(a, b) of the given pairs that tell one story; candidates: id, pack, title, text.

    Both must be of one pack or of related ones. Then any of these tells: titles that share 0.8
    of the smaller one's words; stories that share 0.62 of the smaller one's and five at least,
    or four of which one is a marker; titles that are alike sign by sign. Words count once.
    Measures of words are decided first, in the generated code; only titles whose lengths let
    them be alike are compared sign by sign.
    """
    words = F.filter(F.array_distinct(F.split(story_text(F.concat_ws(" ", "title", "text")), " ")), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$") & ~w.isin(*stop_words))
    sig = signature(F.col("title"))
    side = candidates.select("id", "pack", sig.alias("sig"), F.array_distinct(F.split(sig, " ")).alias("head"), words.alias("story"))
    x = side.select(F.col("id").alias("a"), F.struct("pack", "sig", "head", "story").alias("x"))
    y = side.select(F.col("id").alias("b"), F.struct("pack", "sig", "head", "story").alias("y"))
    packs = F.col("x.pack") == F.col("y.pack")
    for p, q in related:
        packs |= F.col("x.pack").isin(p, q) & F.col("y.pack").isin(p, q)
    both = pairs.join(x, "a").join(y, "b").filter(packs & F.expr("x.sig <> '' and y.sig <> ''"))
    both = both.withColumn("shared", F.array_intersect("x.story", "y.story"))
    smaller = lambda p, q: F.greatest(F.least(F.size(p), F.size(q)), F.lit(1))
    title = F.size(F.array_intersect("x.head", "y.head")) / smaller("x.head", "y.head") >= 0.8
    n = F.size("shared")
    story = (n >= 5) & (n / smaller("x.story", "y.story") >= 0.62)
    if markers:
        story |= (n >= 4) & F.arrays_overlap("shared", F.array(*map(F.lit, markers)))
    decided = both.withColumn("same", title | story)
    p, q = F.length("x.sig"), F.length("y.sig")
    spelt = decided.filter(~F.col("same") & (2 * F.least(p, q) >= ratio * (p + q))).filter(sequence_ratio(F.col("x.sig"), F.col("y.sig")) >= ratio)
    return decided.filter("same").select("a", "b").unionByName(spelt.select("a", "b"))


def first_told(candidates: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """The candidates that no accepted earlier one tells: each is probed in order against those accepted so far.

    pairs: (a, b) that tell one story. No group of linked ones is read whole.
    """
    return candidates.join(first_unlinked(candidates.select("id", F.col(order).alias("place")), pairs), "id", "left_semi")
