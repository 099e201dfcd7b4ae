"""What discovery rejects, what a source is worth, and when a candidate was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import col
from skeinwork.operators.rules import lexicons_in, once

#: Parts of a candidate's title, url, source or text, in lower case.
EVERGREEN = ("top 10", "top ten", "report 2026", "guide", "market overview", "applications", "trends 2026", "what is")
LOW_SIGNAL = ("partner-content", "sponsored", "advertorial", "medium.com", "letsdatascience.com")
PRESS_RELEASE = ("pr newswire", "business wire", "globe newswire", "globenewswire", "stock titan", "ein presswire")
TABLOID = ("new york post", "the sun", "daily mail", "mirror")
VEHICLE = ("vehicle", "vehicles", "automotive", "adas", "in-cabin", "driver assistance")
DEPLOYED = ("factory", "plant", "warehouse", "site", "facility", "construction", "industrial", "production")
HOUSING_POLICY = ("mayor", "campaign", "candidate", "city council", "zoning", "land use", "rezoning", "neighborhood", "neighbourhood", "affordable housing plan", "housing plan")
HOUSING_DELIVERY = (
    "approval", "approvals", "permit", "permits", "completion", "completions", "construction code", "code reform", "building code", "building safety regulator", "gateway", "planning period", "planning delay", "delivery capacity",
    "construction productivity", "construction system", "prefab", "prefabricated", "modular", "offsite", "timber", "mass timber", "lvl", "light gauge steel", "non-traditional materials", "elevator", "factory capacity",
)
#: Packs of queries that rules name.
PHYSICAL_AI_PACK, HOUSING_PACKS = "industrial_robotics_physical_ai", ("housing_delivery_bottlenecks", "industrialized_housing_systems")
#: How dates are written.
FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
SHAPES = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", r"^\d{1,2} [A-Za-z]{4,} \d{4}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$")
#: Reason and condition, first that holds.
REJECTS: tuple[tuple[str, str], ...] = (
    ("already_seen_in_bot_history", "seen"),
    ("low_confidence", "coalesce(confidence, '') NOT IN ('medium', 'high')"),
    ("missing_or_unparseable_published_date", "told_at IS NULL"),
    ("outside_freshness_window", "told_at < oldest"),
    ("evergreen_or_report_like_content", "d_evergreen OR d_evergreen_url"),
    ("low_signal_source_or_partner_content", "d_low_signal"),
    ("automotive_or_vehicle_ai_without_factory_deployment", f"pack = '{PHYSICAL_AI_PACK}' AND d_vehicle AND NOT d_deployed"),
    ("housing_policy_without_delivery_system_signal", f"pack IN {HOUSING_PACKS} AND d_policy AND NOT d_delivery"),
)
REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in REJECTS) + " END"


def published(value: Column | str, now: Column) -> Column:
    """When a candidate says it was published: a date, today, yesterday, days ago; null for weeks, months and all else."""
    v = F.trim(col(value))
    low = F.lower(v)
    days = F.regexp_extract(low, r"^(\d+) .*days ago$", 1)
    out = F.when(low == "today", now).when((low == "yesterday") | low.endswith("day ago"), now - F.expr("interval 1 day")).when(days != "", now - F.make_interval(days=days.cast("int")))
    for shape, form in zip(SHAPES, FORMATS):
        out = out.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(form)))
    rfc = r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4}) (\d{2}:\d{2}:\d{2}) (?:GMT|UTC)$"
    return out.when(v.rlike(rfc), F.try_to_timestamp(F.regexp_replace(v, rfc, "$1 $2 $3 $4"), F.lit("d MMM yyyy HH:mm:ss")))


def evaluated(candidates: DataFrame, now: Column, freshness_days: int) -> DataFrame:
    """candidates and reason (null: accepted as far as they go by themselves), source_quality, priority.

    candidates: title, url, source_name, summary, why_relevant, matched_signal, pack, confidence,
    published_date, seen.
    """
    text = lambda *names: F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    where = F.lower(F.concat_ws("\n", "url", F.coalesce("source_name", F.lit("")), "title"))
    looked = once(candidates, _told=published("published_date", now), _story=text("title", "summary", "why_relevant", "matched_signal"), _where=where, _title=F.lower("title"), _url=F.lower("url"))
    find = lambda c, **sets: lexicons_in(F.col(c), sets, whole=False)
    looked = looked.withColumns({
        "_a": find("_title", d_evergreen=EVERGREEN), "_b": find("_url", d_evergreen_url=tuple(m.replace(" ", "-") for m in EVERGREEN)), "_c": find("_where", d_low_signal=LOW_SIGNAL, d_press=PRESS_RELEASE, d_tabloid=TABLOID),
        "_d": find("_story", d_vehicle=VEHICLE, d_deployed=DEPLOYED, d_policy=HOUSING_POLICY, d_delivery=HOUSING_DELIVERY),
    })
    hits = looked.select(*candidates.columns, F.col("_told").alias("told_at"), (now - F.make_interval(days=F.lit(freshness_days))).alias("oldest"), "_a.*", "_b.*", "_c.*", "_d.*")
    quality = "CASE WHEN d_press THEN 'press_release_rehost' WHEN d_tabloid THEN 'tabloid_verify_better_source' END"
    priority = "CASE WHEN d_press THEN 'verify_primary_source' WHEN confidence = 'high' AND NOT d_tabloid THEN 'likely_post' ELSE 'watch_only' END"
    return hits.selectExpr(*[f"`{c}`" for c in candidates.columns], "told_at", f"{REASON} AS reason", f"{quality} AS source_quality", f"{priority} AS priority")


def query_plan(packs: DataFrame, most: int) -> DataFrame:
    """place, pack, query: the packs' queries in turn (each pack's first, then each one's second), as many as may be asked."""
    turns = packs.select("pack", "position", F.posexplode("queries").alias("turn", "query"))
    return turns.orderBy("turn", "position").limit(most).select("turn", "pack", "query")
