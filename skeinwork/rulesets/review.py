"""The taxonomy that a review's medium confidence is read by: eleven buckets, first match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.rules import haystack, lexicons_in, once

#: Parts of a story's lower-cased text; parts of words count.
PARTS: dict[str, tuple[str, ...]] = {
    "r_robots": ("robot", "robots", "robotic", "robotics", "cobot", "cobots", "amr", "amrs", "mobile robot", "mobile robots", "humanoid", "humanoids"),
    "r_component": (
        "robotic hand", "robotic hands", "robot hand", "robot hands", "dexterous hand", "dexterous hands", "dexterous manipulation", "robotic manipulation", "humanoid hand", "humanoid hands", "humanoid component", "humanoid components",
        "end effector", "end-effectors", "gripper", "grippers",
    ),
    "r_performance": ("revenue", "sales", "orders", "margin", "earnings", "quarter", "q1", "q2", "q3", "q4", "segment", "growth", "decline", "rose", "rises", "fell", "falls"),
    "r_money": ("funding", "funding round", "raises", "raised", "round", "valuation", "valued at", "targets", "targeting", "investor", "investors", "billion", "$"),
    "r_infrastructure": ("infrastructure", "data center", "data centers", "data centre", "data centres", "construction capacity", "buildout", "energy assets", "land and infrastructure"),
    "r_physical_platform": ("physical ai", "physics ai", "ai platform", "platform for physical industries", "platform opportunity"),
    "r_platform_field": ("industrial", "manufacturing", "robotics", "infrastructure", "construction"),
    "r_enablement": (
        "manufacturing language model", "industrial automation design", "automation engineering", "automation cell design", "cell design", "deployment engineering", "commissioning", "integration", "integrated solution", "joint solution",
        "joint offering", "combined offering", "autonomous industrial automation", "industrial automation systems", "programming", "cad", "high-mix, low-volume", "factory automation workflows",
    ),
    "r_enabled_field": ("automation", "robot", "robotics", "factory", "manufacturing", "industrial"),
    "r_greenhouse": ("greenhouse", "greenhouses", "horticulture", "harvesting robot", "harvesting robots", "robot-ready", "agritech", "growers"),
    "r_greenhouse_work": ("automation", "robot", "robotics", "automated", "physical"),
    "r_procurement": ("procurement automation", "purchase orders", "approval history", "erp", "back-office", "workflow automation", "audit-ready supply chains"),
    "r_security": ("access control", "security automation", "industrial iot", "iiot", "real-time security", "connected sensors"),
    "r_auction": ("auction", "liquidate", "liquidation", "surplus equipment", "surplus inventory", "asset disposition"),
    "r_explainer": ("here's how", "what does", "who can", "how do", "who are the competitors", "how to ride", "crash record"),
    "r_rides": ("robotaxi", "self-driving", "ride-hailing", "waymo one", "how to ride", "crash record", "autonomous rides", "consumer cars"),
    "r_not_only_policy": ("robot", "automation", "factory", "construction", "housing"),
}
#: Bucket and condition, first that holds.
BUCKETS: tuple[tuple[str, str], ...] = (
    ("consumer_robotaxi_or_av_service", "r_rides"),
    ("security_access_control_iiot", "r_security"),
    ("backoffice_procurement_workflow", "r_procurement"),
    ("auction_liquidation_surplus", "r_auction"),
    ("generic_finance_or_explainer", "r_explainer OR (timber_policy_signal AND NOT r_not_only_policy)"),
    ("humanoid_robotics_component_funding", "r_component AND r_robots AND r_money"),
    ("robotics_led_infrastructure", "(r_robots AND r_infrastructure) OR (r_physical_platform AND r_platform_field)"),
    ("robotics_business_performance", "r_robots AND r_performance"),
    ("industrial_automation_engineering_enablement", "r_enablement AND r_enabled_field"),
    ("greenhouse_ag_automation", "r_greenhouse AND r_greenhouse_work"),
)
#: Buckets that a promotion of medium confidence may come from.
PROMOTABLE = ("robotics_led_infrastructure", "robotics_business_performance", "industrial_automation_engineering_enablement", "humanoid_robotics_component_funding")
BUCKET = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in BUCKETS) + " ELSE 'other' END"


def reviewed(items: DataFrame, title: str = "title", preview: str = "text_preview") -> DataFrame:
    """items (with timber_policy_signal) and review_bucket; the text is looked through once a row."""
    looked = once(items, _said=haystack(title, preview))
    return looked.withColumn("_hits", lexicons_in(F.col("_said"), PARTS, whole=False)).select(*items.columns, "_hits.*").selectExpr(*[f"`{c}`" for c in items.columns], f"{BUCKET} AS review_bucket")


def reviewed_sql(items: str) -> str:
    quoted = lambda p: p.replace("'", "''")
    hits = ", ".join("(" + " OR ".join(f"contains(said, '{quoted(p)}')" for p in listed) + f") AS {k}" for k, listed in PARTS.items())
    return f"SELECT *, {BUCKET} AS review_bucket FROM (SELECT *, {hits} FROM (SELECT *, lower(title || ' ' || coalesce(text_preview, '')) AS said FROM ({items})))"
