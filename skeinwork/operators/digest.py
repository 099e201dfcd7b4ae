"""The week's selection: one per event, capped by rank."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators import rank
from skeinwork.operators.relational import small
from skeinwork.operators.shared import stored


def digest_order(bucket_rank: Column) -> list[Column]:
    return [bucket_rank.asc(), F.col("sent").desc(), F.col("signal").desc(), F.col("score").desc(), F.col("id").asc()]


def _distinct(rows: list[dict]) -> list[dict]:
    """First sight by event, url and title; by funding key where there is one."""
    seen: set = set()
    out = []
    for r in rows:
        keys = [("event", r["id"]), ("url", (r["url"] or "").strip().lower()), ("title", " ".join((r["title"] or "").lower().split())), ("story", r["story"])]
        keys = [k for k in keys if k[1] and not pd.isna(k[1])]
        if not any(k in seen for k in keys):
            out.append(r)
            seen.update(keys)
    return out


def prepare(rows: list[dict], limit: int, preferred: Sequence[str], weak: Sequence[str]) -> list[dict]:
    """Manual picks; then one of each preferred bucket, sent before stored; sent ones; stored ones; the rest.

    rows come in digest order. Stored ones are only taken while fewer than five are chosen; rows
    that aren't eligible are no candidates at all.
    """
    rows = [r for r in rows if r.get("eligible", True)]
    chosen = _distinct([r for r in rows if r["manual"]])
    if len(chosen) >= limit:
        return chosen[:limit]
    taken = {r["id"] for r in chosen}
    rest = [r for r in rows if r["id"] not in taken and not r["noise"]]
    strong = [r for r in rest if r["bucket"] not in weak]
    sent, stored = (_distinct([r for r in strong if r["sent"] == s]) for s in (True, False))
    picks = []
    for bucket in preferred:
        pick = next((r for pool in (sent, stored) for r in pool if r["bucket"] == bucket and r["id"] not in taken), None)
        if pick:
            picks.append(pick)
            taken.add(pick["id"])
    chosen += picks + [r for r in sent if r["id"] not in taken]
    if len(chosen) < min(limit, 5):
        chosen += [r for r in stored if r["id"] not in taken]
    if len(chosen) >= min(limit, 5):
        return chosen[:limit]  # what is enough isn't searched for repeats again
    have = {r["id"] for r in chosen}
    return _distinct(chosen + _distinct([r for r in rest if r["id"] not in have]))[:limit]


def sent_first(rows: list[dict], limit: int, preferred: Sequence[str], weak: Sequence[str]) -> list[dict]:
    """Manual and sent ones prepared first; stored ones prepared for the places that are left."""
    rows = _distinct(rows)
    first = prepare([r for r in rows if r["manual"] or r["sent"]], limit, preferred, weak)
    have = {r["id"] for r in first}
    stored = [r for r in rows if not (r["manual"] or r["sent"]) and r["id"] not in have]
    return _distinct(first + (prepare(stored, limit - len(first), preferred, weak) if len(first) < limit else []))[:limit]


def select_distinct(prepared: list[dict], wanted: Sequence[str], k: int = 5) -> list[dict]:
    """k stories: mandatory ones, then those asked for, then the rest in order."""
    by_id = {r["id"]: r for r in prepared}
    return _distinct([r for r in prepared if r["manual"]] + [by_id[i] for i in wanted if i in by_id] + prepared)[:k]


def weekly(candidates: DataFrame, limit: int, preferred: Sequence[str], weak: Sequence[str], ranks: Column, stored_last: bool = False) -> DataFrame:
    """week, place, id of each week's prepared rows; stored_last: sent ones are prepared first, by themselves.

    candidates: week, id, url, title, story, bucket, sent, manual, noise, signal, score, and
    eligible if not all are. Rows that aren't eligible don't move. Of a pool's rows that repeat
    none before them, no choice needs more than the first few (each row before them can make no
    more than four of them a repeat) and the first of each preferred bucket: these are found for all
    weeks at once (first_few_seen_any), without moving the others. So the task that prepares a
    week reads a number of rows that doesn't grow with the week.
    """
    if "eligible" in candidates.columns:
        candidates = candidates.filter("eligible")
    read = candidates.select("week", "id", "url", "title", "story", "bucket", "sent", "manual", "noise", F.struct(F.col("manual").cast("int").alias("m"), *[c.alias(f"c{i}") for i, c in enumerate([-ranks, F.col("sent").cast("int"), F.col("signal"), F.col("score")])]).alias("best"), F.monotonically_increasing_id().alias("row"))
    rows = stored(read)
    order, ties = [F.desc("best"), F.col("id"), F.col("row")], ("id", "row")
    keys = [F.col("id"), F.lower(F.trim("url")), F.trim(F.regexp_replace(F.lower("title"), r"\s+", " ")), F.col("story")]
    many = 5 * (limit + len(preferred)) + limit
    if stored_last:  # repeats of all rows of a week count, whichever pool they are in
        # first_seen_any() takes the smallest first: places are told once, by a sort over all rows.
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        rows = stored(rank.first_seen_any(stored(placed), "place", [], keys, [F.col("week")]).drop("place"))

    def pool(df: DataFrame, n: int, within: Sequence[str], part: str | None = None) -> DataFrame:
        if not stored_last:
            return rank.first_few_seen_any(df, "best", ties, keys, within, n, part)
        ranked = lambda *by: F.row_number().over(Window.partitionBy(*within, *by).orderBy(*order))
        first = df.withColumn("_r", ranked()).filter(F.col("_r") <= n)
        if part:
            first = first.unionByName(df.filter(F.col(part).isNotNull()).withColumn("_r", ranked(part)).filter("_r = 1")).dropDuplicates(["row"])
        return stored(first.drop("_r"))

    manual = pool(rows.filter("manual"), limit, ["week"])
    rest = rows.join(manual.select("week", "id"), ["week", "id"], "left_anti").filter("not noise").select(rows.columns)
    strong = rest.filter(~F.coalesce(F.col("bucket").isin(*weak), F.lit(False)) & F.col("sent").isNotNull())
    few = manual.unionByName(pool(strong.withColumn("part", F.when(F.col("bucket").isin(*preferred), F.col("bucket"))), many, ["week", "sent"], "part").drop("part"))
    if stored_last:
        few = few.unionByName(pool(rest, many, ["week", "sent"]))
    else:  # weeks that have enough without them don't look at weak ones
        enough = few.groupBy("week").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= min(limit, 5)).select("week")
        few = few.unionByName(pool(rest.join(small(enough), "week", "left_anti").select(rows.columns), many, ["week"]))
    few = few.dropDuplicates(["row"])
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("week").orderBy(*order))).drop("best", "row")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = (sent_first if stored_last else prepare)(pdf.sort_values("place").to_dict("records"), limit, preferred, weak)
        return pd.DataFrame([(r["week"], i, str(r["id"])) for i, r in enumerate(chosen, 1)], columns=["week", "place", "id"])

    return few.groupBy("week").applyInPandas(choose, "week string, place int, id string")
