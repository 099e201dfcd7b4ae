"""Event flags, scores and the relevance decision: conditions over a vocabulary, in SQL.

A condition names lexicons (a term of theirs occurs), measures, columns of the item and flags
above it. The same text is run by Spark and, in tests, by other engines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.rules import haystack, lexicons_in, once, sql_term_pattern
from skeinwork.rulesets.event_terms import EVENT_TERMS
from skeinwork.rulesets.scope_terms import SCOPE_TERMS

TERMS = EVENT_TERMS | SCOPE_TERMS

#: Amounts that tell a scale, amounts in billions, and a low price.
_SCALE = r"\b(\d+(\.\d+)?x|\d+[,\d]*\s?(sqm|sq m|square metre|square meter|m2|square foot|square feet|sq ft|sqft|sf|percent|%)|\$?\d+[,\d]*(\.\d+)?\s?(m|bn|billion|million))\b"
_BILLIONS = r"\b(\$?\d+[,\d]*(\.\d+)?\s?(b|bn|billion)|valued at\s+\$?\d+[,\d]*(\.\d+)?\s?(b|bn|billion)|valuation\s+of\s+\$?\d+[,\d]*(\.\d+)?\s?(b|bn|billion))\b"
_PRICE, LOW_PRICE = r"\$?\s?([1-9]\d{0,2}(?:,\d{3})+|\d{3,5})\b", 10000

#: Scopes that a source's metadata may name.
GERMAN, BRITISH, BUILDING, ENGINEERING = "germany_housing_market", "uk_housing_market", "construction_timber_innovation", "industrial_robotics_physical_ai"
ROBOT_TAGS = ("robotics", "robot", "humanoid", "industrial")

#: Columns of an item that conditions may name, beside its text.
ITEM = ("timber_api", "statistics_source", "market_listing", "general_business", "broad_feed", "market_scope", "strict_scope", "robot_tags", "competitors", "fresh", "direct", "wrapper")

#: Flag, condition, weight (None: recorded, adds nothing).
FLAGS: tuple[tuple[str, str, int | None], ...] = (
    ("funding_event", "funding AND NOT raised_otherwise", 18),
    ("partnership_event", "partnership", 16),
    ("acquisition_event", "acquisition", 20),
    ("deployment_event", "deployment", 20),
    ("factory_opening_or_expansion", "factory OR (opening_verb AND factory_context)", 18),
    ("permitting_or_code_signal", "code_policy", 18),
    ("quantified_scale_signal", "quantified", 15),
    ("timber_strategic_signal", "timber AND (timber_strategic OR quantified)", 15),
    ("timber_performance_signal", "timber AND timber_performance", 12),
    ("industrial_robotics_signal", "(robot_or_autonomy AND industrial_robotics) OR (robot_word AND strategic_context)", 8),
    ("robotic_timber_fabrication_signal", "timber_api AND timber AND timber_fabrication AND (industrial_robotics_signal OR robotic_word)", 14),
    ("adaptive_reuse_housing_delivery_signal", "timber_api AND timber AND reuse_delivery AND reuse_housing AND reuse_speed", 22),
    ("national_robotics_strategy_signal", "broad_feed AND strategy_robot AND robotics_strategy", 16),
    ("robot_safety_governance_signal", "governed_robot AND robot_governance AND governance_world", 12),
    ("humanoid_affordability_signal", "humanoid AND affordability AND low_price", 8),
    ("construction_innovation_signal", "quantified AND construction_innovation", 6),
    ("construction_statistics_signal", "statistics_source AND statistics_subject AND statistics_sign", 18),
    ("housing_market_signal", f"(market_scope = '{GERMAN}' AND german_market AND (market_sign OR german_policy)) OR (market_scope = '{BRITISH}' AND uk_housing AND market_sign)", 12),
    ("construction_news_intelligence_signal", "market_listing AND uk_construction AND (uk_programme OR (uk_priority AND market_sign)) AND NOT uk_other_sector", 12),
    ("timber_policy_signal", "timber_api AND timber_narrow AND timber_policy", 18),
    ("timber_economics_signal", "timber_api AND timber_narrow AND timber_cost AND timber_quantified AND timber_barrier", 18),
    ("timber_mid_rise_housing_signal", "timber_api AND timber AND mid_rise", None),
    ("timber_institutional_adoption_signal", "timber_api AND timber AND institution", None),
    ("construction_briefing_scope_signal", f"strict_scope = '{BUILDING}' AND briefing_scope", 6),
    ("interesting_engineering_scope_signal", f"strict_scope = '{ENGINEERING}' AND engineering_scope", 6),
    ("product_launch_event", "launch_verb AND launch_noun AND (launch_operation OR industrial_robotics_signal OR construction_innovation_signal)", None),
    ("strategic_ai_major_deal_signal", "broad_feed AND ai_core AND ai_physical AND (((funding_event OR acquisition_event) AND (quantified OR major_deal)) OR (partnership_event AND quantified AND strategic_word))", None),
    ("strategic_capability_acquisition_signal", "acquisition AND capability_target AND (capability_company OR strategic_context OR ai_word)", 12),
    ("physical_industry_ai_megafunding_signal", "(ai_company OR (funding_event AND ai_model)) AND (funding_event OR billions) AND (physical_strong OR (billions AND weak_terms >= 2))", None),
    ("showcase_only_architecture_penalty", "timber AND timber_showcase AND NOT (timber_policy_signal OR timber_strategic_signal OR adaptive_reuse_housing_delivery_signal)", -20),
    ("consumer_robotics_penalty", "false", -50),
    ("adjacent_logistics_only", "logistics AND NOT strategic_context", None),
)
FLAG_NAMES = tuple(name for name, _, _ in FLAGS)
#: What an item's source and its competitors add to its score.
SOURCE_WEIGHTS = {"direct": 25, "statistics_source": 8, "timber_api": 8, "wrapper": -30, "competitors > 0": 35}
#: Scores from which an item is listed and sent.
SHORTLIST, SEND = 20, 28

#: What is out of scope, by the rule that says so first.
OFF_SCOPE: tuple[tuple[str, str], ...] = (
    ("military", "military"),
    ("rides", "ride_service AND ride_guide AND NOT (industrial_context OR autonomy_exception)"),
    ("pharma", "(pharma OR space_pharma OR (medical AND (medical_business OR space_word))) AND NOT robot_exception"),
    ("medical_robotics", "medical AND (robotics OR automation) AND NOT (industrial_context OR built)"),
    ("consumer_robot", "consumer_robot AND NOT industrial_context"),
    ("business_profile", "business_profile AND NOT (industrial_context OR built)"),
    ("timber_logistics", "timber_narrow AND timber_logistics AND NOT timber_kept"),
    ("strict_scope", f"strict_scope = '{ENGINEERING}' AND engineering_off_scope AND NOT interesting_engineering_scope_signal"),
)
#: Flags that put an item in scope whatever else it says.
IN_SCOPE_FLAGS = (
    "strategic_ai_major_deal_signal", "strategic_capability_acquisition_signal", "physical_industry_ai_megafunding_signal", "construction_statistics_signal", "construction_news_intelligence_signal", "housing_market_signal",
    "timber_policy_signal", "timber_economics_signal", "timber_mid_rise_housing_signal", "timber_institutional_adoption_signal", "robotic_timber_fabrication_signal", "adaptive_reuse_housing_delivery_signal",
    "national_robotics_strategy_signal", "robot_safety_governance_signal", "construction_briefing_scope_signal", "interesting_engineering_scope_signal", "timber_strategic_signal",
)
#: Conditions over flags and terms that follow the flags, in order; later ones may name earlier ones.
DERIVED: tuple[tuple[str, str], ...] = (
    ("industrial_launch", "robotics AND robotics_launch AND robotics_product"),
    ("logistics_in_scope", "warehousing AND (built OR (robotics AND plant_word AND (deployment_event OR funding_event OR partnership_event)))"),
    ("in_scope", " OR ".join((
        "competitors > 0", *IN_SCOPE_FLAGS, "broad_scope", "(robotics_business AND performance)", "industrial_launch", "(robotics AND (work_place OR robotics_context))",
        "(funding_event AND quantified_scale_signal AND robotics AND robot_tags)", "(factory_opening_or_expansion AND (robotics OR robot_tags OR factory_signal))", "(automation AND plant_word)", "logistics_in_scope",
    ))),
    ("profile_noise", "business_profile AND NOT (industrial_robotics_signal OR construction_innovation_signal OR timber_strategic_signal OR permitting_or_code_signal OR factory_opening_or_expansion)"),
    ("business_in_scope", """NOT general_business OR industrial_robotics_signal OR construction_innovation_signal OR housing_market_signal OR timber_strategic_signal OR timber_policy_signal OR timber_economics_signal
        OR strategic_capability_acquisition_signal OR physical_industry_ai_megafunding_signal OR humanoid_affordability_signal
        OR (business_topic AND (funding_event OR partnership_event OR acquisition_event OR deployment_event OR product_launch_event OR quantified_scale_signal))"""),
    ("strong_signal", """competitors > 0 OR housing_market_signal OR strategic_ai_major_deal_signal OR strategic_capability_acquisition_signal OR physical_industry_ai_megafunding_signal OR national_robotics_strategy_signal
        OR robot_safety_governance_signal OR construction_briefing_scope_signal OR interesting_engineering_scope_signal OR timber_strategic_signal
        OR (high_intent AND (permitting_or_code_signal OR quantified_scale_signal OR factory_opening_or_expansion))
        OR (funding_event AND (high_intent OR (robotics AND work_place) OR (automation AND plant_word) OR (quantified_scale_signal AND robotics AND robot_tags)))
        OR ((robotics OR automation) AND ((partnership_event AND high_intent) OR (deployment_event AND (high_intent OR plant_word))))"""),
    ("on_topic", " OR ".join(("competitors > 0", "topic", *FLAG_NAMES))),
    ("off_scope", "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in OFF_SCOPE) + " END"),
    ("reason", """CASE WHEN NOT fresh THEN 'freshness_failed' WHEN off_scope IS NOT NULL THEN 'obvious_off_scope' WHEN profile_noise THEN 'general_business_profile_noise' WHEN NOT in_scope OR NOT business_in_scope THEN 'no_clear_scope'
        WHEN broad_feed AND NOT strong_signal THEN 'broad_feed_without_strong_signal' WHEN NOT on_topic THEN 'no_clear_topic_signal' END"""),
    ("score", " + ".join([f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in SOURCE_WEIGHTS.items()] + [f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, _, w in FLAGS if w])),
    ("shortlisted", f"reason IS NULL AND fresh AND score >= {SHORTLIST}"),
)


def item_columns(items: DataFrame, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """items with the columns that conditions name, from source_id, layer, is_wrapper and metadata.

    roles: which source ids are timber_api, statistics_source, market_listing, general_business.
    metadata: map of strings (broad_feed, market_scope, strict_scope, tags joined by commas).
    """
    meta = lambda k: F.nullif(F.trim(F.col("metadata")[k]), F.lit(""))
    of = {role: F.col("source_id").isin(*roles.get(role, ())) for role in ("timber_api", "statistics_source", "market_listing", "general_business")}
    tags = F.split(F.lower(F.coalesce(meta("tags"), F.lit(""))), r"\s*,\s*")
    return items.withColumns(of | {
        "broad_feed": F.coalesce(F.lower(meta("broad_feed")).isin("true", "1", "yes"), F.lit(False)), "market_scope": F.coalesce(meta("market_scope"), F.lit("")), "strict_scope": F.coalesce(meta("strict_scope"), F.lit("")),
        "robot_tags": F.arrays_overlap(tags, F.array(*map(F.lit, ROBOT_TAGS))), "direct": F.col("layer") == "direct", "wrapper": F.col("is_wrapper") & (F.col("layer") == "google_competitor"),
    })


def _measures(text: Column) -> dict[str, Column]:
    price = F.regexp_extract(text, _PRICE, 1)
    return {"quantified": text.rlike(_SCALE), "billions": text.rlike(_BILLIONS), "low_price": F.coalesce(F.try_to_number(F.replace(price, F.lit(","), F.lit("")), F.lit("99999999999")) <= LOW_PRICE, F.lit(False))}


_WEAK = " + ".join(f"CAST(physical_weak_{i} AS INT)" for i in range(1, 5))


def judged(items: DataFrame, title: str = "title", preview: str = "text_preview", terms: Mapping[str, Sequence[str]] = TERMS, patterns: Mapping[str, str] | None = None, keep_text: str | None = None) -> DataFrame:
    """items (with the columns of ITEM) and the flags, off_scope, reason (null: kept), score, shortlisted and what they rest on.

    Text is looked up once a row; all conditions are evaluated on the hits. More
    terms and patterns may be looked up, and the text kept, for conditions that follow.
    """
    looked = once(items, _text=haystack(title, preview))
    text = F.col("_text")
    found = _measures(text) | {k: text.rlike(p) for k, p in (patterns or {}).items()}
    looked = once(looked, _measured=F.struct(*[c.alias(k) for k, c in found.items()])).withColumn("_hits", lexicons_in(text, terms))
    looked = looked.select(*items.columns, *([text.alias(keep_text)] if keep_text else []), "_measured.*", "_hits.*").selectExpr("*", f"{_WEAK} AS weak_terms")
    return looked.selectExpr("*", *[f"coalesce({c}, false) AS {n}" for n, c, _ in FLAGS]).selectExpr("*", *[f"({c}) AS {n}" for n, c in DERIVED])


def applied() -> Column:
    """Names of the flags that hold, in order, with their weights where they have one."""
    return F.map_filter(F.create_map(*[x for n, _, w in FLAGS for x in (F.lit(n), F.when(F.col(n), F.lit(w or 0)))]), lambda _, w: w.isNotNull())


def judged_sql(items: str, terms: Mapping[str, Sequence[str]] = TERMS, patterns: Mapping[str, str] | None = None) -> str:
    """The same for engines that lack look-around: items is a subquery with id, title, text_preview and the columns of ITEM."""
    quoted = lambda s: s.replace("'", "''")
    hits = [f"regexp_matches(h, '{quoted(sql_term_pattern(listed))}') AS {name}" for name, listed in terms.items()]
    hits += [f"regexp_matches(h, '{p}') AS {k}" for k, p in (patterns or {}).items()]
    hits += [f"regexp_matches(h, '{_SCALE}') AS quantified", f"regexp_matches(h, '{_BILLIONS}') AS billions", f"coalesce(TRY_CAST(replace(regexp_extract(h, '{_PRICE}', 1), ',', '') AS BIGINT) <= {LOW_PRICE}, false) AS low_price"]
    base = f"SELECT *, {', '.join(hits)} FROM (SELECT *, lower(title || ' ' || coalesce(text_preview, '')) AS h FROM ({items}))"
    flags = ", ".join(f"coalesce({c}, false) AS {n}" for n, c, _ in FLAGS)
    derived = ", ".join(f"({c}) AS {n}" for n, c in DERIVED)
    return f"SELECT *, {derived} FROM (SELECT *, {flags} FROM (SELECT *, {_WEAK} AS weak_terms FROM ({base})))"
