"""Queries of the rule sets over made-up stories: one an order, composed of phrases by its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.relational import spread
from skeinwork.plans.registry import Tables, query
from skeinwork.rulesets import editorial, relevance, review, weekly

#: Phrases that stories are composed of; twelve of each.
WHO = ("Acme Robotics", "A humanoid robot maker", "An AI startup", "A mass timber developer", "A robotaxi service", "A hospital", "The port terminal", "A billionaire banker", "The housing market", "An armed forces interview", "A modular prefab builder", "A warehouse logistics group")
DOES = ("raises", "launches a platform and", "acquires", "opens", "partners with", "deployed", "raised concerns about", "unveils a robot for", "merger with", "expands", "announces", "buys")
WHAT = (
    "a robot cell", "a new factory", "timber housing", "student housing converted from offices", "a drug manufacturing line", "industrial automation software", "construction robotics", "a building code approval", "a mansion", "machine vision for factories",
    "mid-rise apartments, a 12-storey timber project with glass and growing demand", "the safety rulebook for real world robots",
)
HOW = (
    "for $40 million", "25 percent higher than before", "2.5x the floor area", "valued at 3 billion", "at an affordable 9,900 price", "in a seed round", "with artificial intelligence", "at a cost six to ten times higher than steel, commercial viability aside",
    "as the housing supply shortage rose", "within a demolition framework", "under the national strategy for robots", "Baugenehmigungen gestiegen",
)
ALSO = (
    "says a podcast interview", "with heat loss 20 per cent lower than in concrete", "after milling by a robotic arm", "despite rezoning concerns", "to train robot ai in a data factory", "and a driverless haul truck", "in a collaboration on industrial automation",
    "over full shifts without intervention", "and a pavilion design award", "in an analysis of the future of work", "with 40 units approved", "in a rail framework",
)


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))


def stories(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    is_ = lambda n, r: c % n == r
    return spread(t.orders).select(
        k.alias("id"), F.concat_ws(" ", _pick(WHO, k), _pick(DOES, F.floor(k / 12)), _pick(WHAT, F.floor(k / 144))).alias("title"), F.concat_ws(" ", _pick(HOW, k * 7 + c), _pick(HOW, c), _pick(ALSO, F.floor(k / 7))).alias("text_preview"),
        is_(5, 0).alias("timber_api"), is_(5, 1).alias("statistics_source"), is_(5, 2).alias("market_listing"), is_(5, 3).alias("general_business"), is_(3, 0).alias("broad_feed"),
        F.when(is_(4, 0), relevance.GERMAN).when(is_(4, 1), relevance.BRITISH).when(is_(4, 2), editorial.BRITISH_BUILDING).otherwise("").alias("market_scope"), F.when(is_(7, 0), relevance.BUILDING).when(is_(7, 1), relevance.ENGINEERING).otherwise("").alias("strict_scope"),
        is_(2, 0).alias("robot_tags"), is_(17, 0).cast("int").alias("competitors"), (~is_(11, 0)).alias("fresh"), is_(2, 1).alias("direct"), is_(13, 0).alias("wrapper"), is_(6, 0).alias("short_feed"),
    )


def _list(words: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({at}) % {len(words)} + 1]"


STORIES_SQL = f"""SELECT o_orderkey AS id, o_orderkey AS k, o_custkey AS c, {_list(WHO, 'o_orderkey')} || ' ' || {_list(DOES, 'o_orderkey // 12')} || ' ' || {_list(WHAT, 'o_orderkey // 144')} AS title,
    {_list(HOW, 'o_orderkey * 7 + o_custkey')} || ' ' || {_list(HOW, 'o_custkey')} || ' ' || {_list(ALSO, 'o_orderkey // 7')} AS text_preview, c % 5 = 0 AS timber_api, c % 5 = 1 AS statistics_source, c % 5 = 2 AS market_listing, c % 5 = 3 AS general_business, c % 3 = 0 AS broad_feed,
    CASE c % 4 WHEN 0 THEN '{relevance.GERMAN}' WHEN 1 THEN '{relevance.BRITISH}' WHEN 2 THEN '{editorial.BRITISH_BUILDING}' ELSE '' END AS market_scope, CASE c % 7 WHEN 0 THEN '{relevance.BUILDING}' WHEN 1 THEN '{relevance.ENGINEERING}' ELSE '' END AS strict_scope,
    c % 2 = 0 AS robot_tags, CAST(c % 17 = 0 AS INT) AS competitors, c % 11 <> 0 AS fresh, c % 2 = 1 AS direct, c % 13 = 0 AS wrapper, c % 6 = 0 AS short_feed FROM orders"""
JUDGED_SQL, GATED_SQL = relevance.judged_sql(STORIES_SQL), editorial.gated_sql(STORIES_SQL)


@query(f"SELECT id, {', '.join(relevance.FLAG_NAMES)} FROM ({JUDGED_SQL})")
def event_flags(t: Tables):
    """The 32 event flags of each story."""
    return relevance.judged(stories(t)).select("id", *relevance.FLAG_NAMES)


@query(f"SELECT id, CAST(score AS INT) AS score, shortlisted, CAST({' + '.join(f'CAST({n} AS INT)' for n in relevance.FLAG_NAMES)} AS INT) AS applied FROM ({JUDGED_SQL})")
def event_score(t: Tables):
    return relevance.judged(stories(t)).select("id", "score", "shortlisted", F.size(relevance.applied()).alias("applied"))


@query(f"SELECT id, off_scope, profile_noise, in_scope, business_in_scope, industrial_launch, strong_signal, on_topic, CASE WHEN reason IS NULL THEN 'keep' ELSE 'drop' END AS status, reason FROM ({JUDGED_SQL})")
def scope_decision(t: Tables):
    """Why a story is out: stale, off scope, a profile, without scope, weak in a broad feed, off topic; the first that holds."""
    j = relevance.judged(stories(t))
    return j.select("id", "off_scope", "profile_noise", "in_scope", "business_in_scope", "industrial_launch", "strong_signal", "on_topic", F.when(F.col("reason").isNull(), "keep").otherwise("drop").alias("status"), "reason")


@query(f"SELECT reason, off_scope, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM ({JUDGED_SQL}) GROUP BY 1, 2")
def scope_counts(t: Tables):
    return relevance.judged(stories(t)).groupBy("reason", "off_scope").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"SELECT id, {', '.join(editorial.FLAG_NAMES)} FROM ({GATED_SQL})")
def editorial_flags(t: Tables):
    """The 32 flags of the gate before sending."""
    return editorial.gated(stories(t)).select("id", *editorial.FLAG_NAMES)


@query(f"SELECT id, send_reason IS NULL AS allowed, send_reason AS reason, protected, promotable, sent_anyway FROM ({GATED_SQL})")
def editorial_gate(t: Tables):
    """Whether a story may be sent, and what a reviewer's answer may change."""
    return editorial.gated(stories(t)).select("id", F.col("send_reason").isNull().alias("allowed"), F.col("send_reason").alias("reason"), "protected", "promotable", "sent_anyway")


#: What a week's story goes on to say.
THEN = (
    "Full shifts without intervention.", "Its total funding grows.", "The marine terminal is a one-stop shop.", "Drugs in orbit.", "An office building project.", "On-site assembly is next.", "SoftBank plans a data center buildout.",
    "It will deploy more.", "Its venture arm raised a fund.", "Want to hire? The talent pool is large.", "How to ride with Waymo.", "Trained in simulation, its viewers say; Hyundai agrees.",
)
_SKIPS = ("", "editorial_not_telegram_worthy", "freshness_failed")
WEEK_SQL = weekly.classified_sql(f"SELECT *, text_preview || ' ' || {_list(THEN, 'id // 5')} AS summary, nullif({_list(_SKIPS, 'id // 3')}, '') AS skip_reason FROM ({JUDGED_SQL})")


def week(t: Tables) -> DataFrame:
    judged = relevance.judged(stories(t)).select("id", "title", "text_preview", *relevance.FLAG_NAMES)
    judged = judged.withColumns({"summary": F.concat_ws(" ", "text_preview", _pick(THEN, F.floor(F.col("id") / 5))), "skip_reason": F.nullif(_pick(_SKIPS, F.floor(F.col("id") / 3)), F.lit(""))})
    return weekly.classified(judged)


@query(f"SELECT id, bucket, CAST(bucket_rank AS INT) AS bucket_rank, noise, eligible FROM ({WEEK_SQL})")
def week_buckets(t: Tables):
    """Bucket and rank of each story in a week, whether it is noise and whether it is a candidate at all."""
    return week(t).select("id", "bucket", "bucket_rank", "noise", "eligible")


@query(f"SELECT id, story_type, array_to_string(guards, ' | ') AS guards FROM ({WEEK_SQL})")
def story_types(t: Tables):
    """Type of each story and what to mind when it is written."""
    return week(t).select("id", "story_type", F.array_join("guards", " | ").alias("guards"))


#: What a reviewed story goes on to say.
GOES_ON = (
    "Revenue rose.", "A funding round for robot hands.", "The data center buildout goes on.", "CAD and commissioning of a factory.", "Growers automate a greenhouse.", "Purchase orders and ERP.", "Access control for sensors.", "An auction of presses.",
    "Here's how it works.", "Nothing more.", "A platform opportunity for construction.", "Prices were told.",
)
_ON = ", ".join("'" + w.replace("'", "''") + "'" for w in GOES_ON)
REVIEW_SQL = review.reviewed_sql(f"SELECT * REPLACE (text_preview || ' ' || [{_ON}][(id // 11) % {len(GOES_ON)} + 1] AS text_preview) FROM ({GATED_SQL})")


@query(f"SELECT id, review_bucket, promotable OR review_bucket IN {review.PROMOTABLE} AS medium_promotes FROM ({REVIEW_SQL})")
def review_taxonomy(t: Tables):
    """Bucket of each story under review and whether an answer of medium confidence may promote it."""
    gated = editorial.gated(stories(t)).select("id", "title", "text_preview", "timber_policy_signal", "promotable")
    out = review.reviewed(gated.withColumn("text_preview", F.concat_ws(" ", "text_preview", _pick(GOES_ON, F.floor(F.col("id") / 11)))))
    return out.select("id", "review_bucket", (F.col("promotable") | F.col("review_bucket").isin(*review.PROMOTABLE)).alias("medium_promotes"))
