"""The gate before sending: flags over the event flags and a vocabulary of its own, rejects in order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skeinwork.rulesets import relevance
from skeinwork.rulesets.send_terms import SEND_TERMS

#: Storeys or units of a building, hours of a shift, and a market scope beside those of the event flags.
_STOREYS, _HOURS, BRITISH_BUILDING = r"\b\d+\s*-\s*storey\b|\b\d+\s*storey\b|\b\d+\s*units?\b", r"\b\d+\s*-\s*hour\b|\b\d+\s*hour\b", "uk_construction_market"
PATTERNS = {"s_storeys": _STOREYS, "s_hours": _HOURS, "s_hundred": "100 "}
#: What the gate reads of an item beside relevance.ITEM: whether it comes from the feed whose previews are cut short.
ITEM = (*relevance.ITEM, "short_feed")

#: Flag and condition. Names of event flags stand for these; a flag of the gate begins with `send_`.
FLAGS: tuple[tuple[str, str], ...] = (
    ("send_military_excluded", "s_military"),
    ("send_business_profile_excluded", "s_profile"),
    ("send_thought_leadership_format", "s_leadership OR s_interview"),
    ("send_product_launch", "s_launch"),
    ("send_operational_detail", "s_operation"),
    ("send_construction_execution", "s_execution"),
    ("send_hard_news_event", "deployment_event OR funding_event OR partnership_event OR acquisition_event OR factory_opening_or_expansion OR permitting_or_code_signal OR quantified_scale_signal OR timber_strategic_signal"),
    ("send_industrial_relevance", "industrial_robotics_signal OR deployment_event OR factory_opening_or_expansion OR construction_innovation_signal"),
    ("send_adjacent_logistics_only", "adjacent_logistics_only"),
    ("send_official_construction_market_signal", "statistics_source AND construction_statistics_signal AND s_statistics"),
    ("send_housing_market_alert_signal", f"market_scope IN ('{relevance.GERMAN}', '{relevance.BRITISH}') AND housing_market_signal AND s_housing AND s_housing_sign"),
    ("send_uk_construction_market_alert_signal", f"market_scope = '{BRITISH_BUILDING}' AND construction_news_intelligence_signal AND s_uk AND s_uk_sign"),
    ("send_humanoid_access_signal", "humanoid_affordability_signal AND (s_access OR short_feed)"),
    ("send_timber_adoption_barrier_signal", "timber_api AND timber_policy_signal AND (s_constraint OR (s_policy AND s_friction))"),
    ("send_timber_economics_alert_signal", "timber_api AND timber_economics_signal AND s_economics AND s_times AND s_barrier"),
    ("send_timber_performance_alert_signal", "timber_api AND timber_performance_signal AND s_performance AND s_material AND s_measured"),
    ("send_timber_project_delivery_signal", "timber_api AND timber_policy_signal AND s_project AND s_storeys"),
    ("send_timber_strategic_alert_signal", "timber_api AND timber_strategic_signal AND s_shift AND s_shift_context"),
    ("send_timber_mid_rise_housing_signal", "timber_api AND timber_mid_rise_housing_signal AND s_mid_rise AND s_residential"),
    ("send_timber_institutional_adoption_signal", "timber_api AND timber_institutional_adoption_signal AND s_institution"),
    ("send_strategic_industrial_ai_alert_signal", "broad_feed AND strategic_ai_major_deal_signal AND funding_event AND s_ai_world"),
    ("send_strategic_capability_acquisition_alert_signal", "strategic_capability_acquisition_signal AND acquisition_event AND s_capability"),
    ("send_robot_ai_training_infrastructure_signal", "industrial_robotics_signal AND s_training AND (send_operational_detail OR quantified_scale_signal OR s_hundred)"),
    ("send_heavy_industrial_autonomy_signal", "s_heavy AND (industrial_robotics_signal OR interesting_engineering_scope_signal) AND (deployment_event OR product_launch_event OR quantified_scale_signal OR s_introduced)"),
    ("send_robotic_timber_fabrication_signal", "timber_api AND robotic_timber_fabrication_signal AND s_fabrication"),
    ("send_adaptive_reuse_housing_delivery_signal", "timber_api AND adaptive_reuse_housing_delivery_signal AND s_reuse"),
    ("send_national_robotics_strategy_signal", "national_robotics_strategy_signal AND s_strategy"),
    ("send_robot_safety_governance_signal", "robot_safety_governance_signal AND s_governance"),
    ("send_industrial_automation_partnership_signal", "partnership_event AND industrial_robotics_signal AND s_joint AND s_platform AND (send_operational_detail OR s_plant)"),
    ("send_sustained_factory_operation_signal", "industrial_robotics_signal AND send_operational_detail AND s_sustained AND (s_works OR s_hours)"),
    ("send_tangible_operational_signal", "send_operational_detail OR send_construction_execution OR send_industrial_relevance"),
)
#: Signals that are worth sending by themselves.
WORTHY = tuple(n for n, _ in FLAGS if n.endswith("_signal") and n != "send_tangible_operational_signal")
FLAGS += (
    ("send_telegram_worthy", " OR ".join((
        "(send_hard_news_event AND send_tangible_operational_signal AND NOT adjacent_logistics_only)",
        "(send_product_launch AND send_tangible_operational_signal AND (send_industrial_relevance OR send_construction_execution OR competitors > 0))", "(send_construction_execution AND quantified_scale_signal)", *WORTHY,
    ))),
)
FLAG_NAMES = tuple(n for n, _ in FLAGS)
#: Why an item isn't sent, first that holds.
REJECTS: tuple[tuple[str, str], ...] = (
    ("editorial_military_or_combat_out_of_scope", "send_military_excluded"),
    ("editorial_business_profile_out_of_scope", "send_business_profile_excluded AND competitors = 0"),
    ("editorial_thought_leadership_without_operational_signal", "send_thought_leadership_format AND NOT send_hard_news_event"),
    ("editorial_commentary_without_tangible_detail", "send_thought_leadership_format AND NOT send_tangible_operational_signal"),
    ("editorial_strategic_ai_deal_stored_only", "strategic_ai_major_deal_signal AND NOT send_strategic_industrial_ai_alert_signal"),
    ("editorial_adjacent_logistics_without_signal", "adjacent_logistics_only AND NOT (send_construction_execution OR competitors > 0)"),
    ("editorial_not_telegram_worthy", "NOT send_telegram_worthy"),
)
#: Signals that a reviewer's sure reject doesn't override, and those that a card is sent for although its text failed.
PROTECTED = (
    "send_official_construction_market_signal", "send_housing_market_alert_signal", "send_timber_project_delivery_signal", "send_timber_strategic_alert_signal", "send_timber_mid_rise_housing_signal",
    "send_timber_institutional_adoption_signal",
)
SENT_ANYWAY = tuple(n for n in PROTECTED if n != "send_timber_project_delivery_signal")
#: What makes a story of a framework one of housing, and what makes it one of transport; parts of words count.
HOUSING_PARTS = ("construction output", "construction activity", "project starts", "main contract awards", "materials prices", "labour costs", "workloads", "housebuilding", "housing", "residential", "social housing", "build-to-rent", "btr")
TRANSPORT_PARTS = ("transport for london", "tfl", "transport framework", "infrastructure improvement framework", "rail", "road", "roads", "highway", "station", "airport", "bridge", "tunnel")


def _part(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(h, '{p}')" for p in parts) + ")"


DERIVED: tuple[tuple[str, str], ...] = (
    ("send_reason", "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in REJECTS) + " END"),
    ("housing_framework", f"send_uk_construction_market_alert_signal AND {_part(HOUSING_PARTS)} AND NOT {_part(TRANSPORT_PARTS)}"),
    ("protected", " OR ".join((*PROTECTED, "housing_framework"))),
    ("promotable", "send_official_construction_market_signal OR send_housing_market_alert_signal OR housing_framework"),
    ("sent_anyway", " OR ".join(SENT_ANYWAY)),
)


def gated(items: DataFrame, title: str = "title", preview: str = "text_preview") -> DataFrame:
    """items (with the columns of ITEM), what relevance.judged gives, the gate's flags, send_reason (null:
    may be sent), protected, promotable and sent_anyway."""
    seen = relevance.judged(items, title, preview, relevance.TERMS | SEND_TERMS, PATTERNS, keep_text="h")
    return seen.selectExpr("*", *[f"coalesce({c}, false) AS {n}" for n, c in FLAGS]).selectExpr("*", *[f"({c}) AS {n}" for n, c in DERIVED])


def gated_sql(items: str) -> str:
    judged = relevance.judged_sql(items, relevance.TERMS | SEND_TERMS, PATTERNS)
    flags = ", ".join(f"coalesce({c}, false) AS {n}" for n, c in FLAGS)
    return f"SELECT *, {', '.join(f'({c}) AS {n}' for n, c in DERIVED)} FROM (SELECT *, {flags} FROM ({judged}))"
