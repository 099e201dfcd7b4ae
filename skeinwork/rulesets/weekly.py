"""The week's taxonomies: bucket and rank, story type and what to mind, noise and what isn't eligible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import story_text
from skeinwork.operators.rules import lexicons_in, notes, once

#: Phrases, as they stand in a story's normalised text; parts of words count.
PHRASES: dict[str, tuple[str, ...]] = {
    "w_supply": ("marine terminal", "portland marine terminal", "distribution hub", "production and distribution hub", "one stop shop", "timber supply", "mass timber supply", "former terminal", "willamette river"),
    "w_off_thesis": ("in space drug manufacturing", "drug manufacturing company", "cancer drugs in orbit", "in space manufacturing", "drugs in orbit"),
    "w_timber": ("mass timber", "clt", "lvl posts", "lvl beams", "urban sites", "tight city plot"),
    "w_site": ("building", "office building", "school", "project", "construction", "urban", "site", "concrete sidewalls", "three storey office"),
    "w_robotics": ("construction robotics", "robotic construction", "off site robotic fabrication", "on site assembly", "autonomous building platform", "housing industrialization", "ai assisted design"),
    "w_proof": (
        "systems live", "production picks", "remote human intervention", "reliability", "warehouse production metrics", "production proof", "scaled manufacturing operations", "production lines", "8 hour shifts", "full factory style",
        "factory style", "without intervention", "full shift", "entire shift",
    ),
    "w_infrastructure": ("softbank", "roze", "abb robotics", "data center buildout", "data center growth", "energy land and infrastructure", "physical delivery problem"),
    "w_capital": ("valuation", "total funding", "platform opportunity", "physical industries", "advanced manufacturing", "aerospace", "automotive", "drug discovery", "project prometheus"),
    "w_deployed": ("deploy", "deployment", "humanoids by 2032", "manufacturing facilities"),
    "w_fund": ("venture arm", "venture capital arm", "fund iii", "independent venture capital arm", "launched its third fund", "bet on physical ai and robotics"),
    "w_ride": ("waymo",),
    "w_ride_guide": ("how to ride", "crash record", "robotaxi service"),
    "w_noise": (
        "chefs share", "menu changes", "event logistics", "solo cooking companies", "social strategy", "documentary filmmaker", "founder documentary", "behind the scenes doc", "social media video blitz", "launch video",
        "robo housemaid", "consumer robotics startup", "starts shipping this summer", "tracks ai use", "internal friction", "employees push back", "engineers use ai", "parts of its workforce", "want to hire", "talent pool",
        "industry night", "autonomous vehicle industry is ripe for picking", "experience transfers well",
    ),
    "t_timber": ("timber", "mass timber", "clt", "glulam", "lvl"),
    "t_housing": ("permits", "approvals", "completions", "housing gap", "prices rose", "rents up", "project starts", "planning approvals", "pipeline"),
    "t_sites": ("construction robotics", "construction sites", "jobsite", "retrofit", "automation as a service", "off site robotic fabrication", "on site assembly", "task specific"),
    "t_tooling": ("simulation", "sim to real", "digital twins", "factory robots that behave identically", "trained in simulation", "physical robot behaviour", "nvidia", "fanuc"),
    "t_operating": ("deploy", "deployment", "operating", "factory", "plants", "warehouse", "zero failures", "24 hours", "full shift", "without intervention", "humanoid", "robots are already"),
    "t_capital": ("valuation", "total funding", "advanced manufacturing", "physical industries", "platform opportunity"),
    "t_share": ("consumption fell", "imports rose", "losing share", "light gauge steel", "prefabricated dwelling", "mid rise approvals", "mid rise has overtaken detached"),
    "t_viral": ("viewers", "viral", "livestream", "bob frank and gary", "x as it sorted"),
    "t_own_plants": ("atlas", "hyundai", "own factories", "us plants"),
}
#: Bucket and condition, first that holds; a bucket's rank in the week.
BUCKETS: tuple[tuple[str, str], ...] = (
    ("timber_supply_chain", "w_supply"),
    ("weak_off_thesis", "w_off_thesis"),
    ("mass_timber_construction", "(timber_strategic_signal OR w_timber) AND w_site"),
    ("construction_robotics", "w_robotics"),
    ("physical_ai_proof", "industrial_robotics_signal AND w_proof"),
    ("infrastructure_platform_signal", "w_infrastructure"),
    ("strategic_capital_bet", "funding_event AND w_capital"),
    ("construction_statistics", "construction_statistics_signal"),
    ("industrial_deployment", "(industrial_robotics_signal OR deployment_event) AND w_deployed"),
    ("weak_generic_funding", "funding_event AND w_fund"),
)
RANKED = (
    "physical_ai_proof", "mass_timber_construction", "strategic_capital_bet", "infrastructure_platform_signal", "construction_robotics", "construction_statistics", "industrial_deployment", "general_relevant", "timber_supply_chain",
    "weak_generic_funding", "weak_off_thesis",
)
#: Story type and condition, first that holds.
TYPES: tuple[tuple[str, str], ...] = (
    ("timber_adoption", "timber_strategic_signal OR timber_policy_signal OR timber_economics_signal OR timber_performance_signal OR t_timber"),
    ("housing_market_signal", "construction_statistics_signal OR t_housing"),
    ("construction_robotics_funding", "funding_event AND (construction_innovation_signal OR t_sites)"),
    ("robotics_tooling", "t_tooling"),
    ("industrial_deployment", "(industrial_robotics_signal OR deployment_event) AND t_operating"),
    ("strategic_capital", "funding_event AND t_capital"),
)
OTHER, OTHER_NOTE = "general_relevant", "Keep to the strongest fact and what follows from it."
#: What to mind when a story of a type is written; with a phrase set, only where it holds.
GUARDS: tuple[tuple[str, str | None, str], ...] = (
    ("timber_adoption", None, "Tell what holds adoption back or shifts shares, not that timber is on the rise."),
    ("timber_adoption", "t_share", "Tell the contradiction: demand rises while timber loses share."),
    ("construction_robotics_funding", None, "Tell the work that is changed and what it saves; investors come second."),
    ("industrial_deployment", None, "Tell what the run proves and what it doesn't."),
    ("industrial_deployment", "t_viral", "Leave out the audience and nicknames."),
    ("industrial_deployment", "t_own_plants", "Tell it as a test in the maker's own plants and a commitment to scale."),
    ("robotics_tooling", None, "Tell what it does to the cost, speed or reliability of a deployment."),
    ("housing_market_signal", None, "Name the constraint: permits, completions, time."),
    ("strategic_capital", None, "Tell what the money is a bet on."),
)
NOISE = "w_noise OR (w_ride AND w_ride_guide)"
#: Reasons after which an item is no candidate of a week.
INELIGIBLE = ("claude_editorial_rejected", "editorial_not_telegram_worthy", "editorial_thought_leadership_without_operational_signal")


def _case(cases: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in cases) + f" ELSE '{otherwise}' END"


BUCKET, TYPE = _case(BUCKETS, OTHER), _case(TYPES, OTHER)
RANK = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(RANKED)) + " ELSE 50 END"
ELIGIBLE = "NOT adjacent_logistics_only AND coalesce(skip_reason, '') NOT IN (" + ", ".join(f"'{r}'" for r in INELIGIBLE) + ")"


def guards() -> Column:
    kind = F.col("story_type")
    told = notes([((kind == t) & (F.col(p) if p else F.lit(True)), n) for t, p, n in GUARDS])
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(OTHER_NOTE)))


def classified(items: DataFrame, title: str = "title", summary: str = "summary") -> DataFrame:
    """items (with the event flags and skip_reason) and bucket, rank, story_type, guards, noise, eligible.

    A story's phrases are looked up once a row, as parts of its normalised text.
    """
    looked = once(items, _story=F.trim(F.concat_ws(" ", story_text(title), story_text(summary))))
    looked = looked.withColumn("_hits", lexicons_in(F.col("_story"), PHRASES, whole=False)).select(*items.columns, "_hits.*")
    out = looked.selectExpr("*", f"{BUCKET} AS bucket", f"{TYPE} AS story_type", f"({NOISE}) AS noise", f"({ELIGIBLE}) AS eligible").selectExpr("*", f"{RANK} AS bucket_rank")
    return out.withColumn("guards", guards()).drop(*PHRASES)


def classified_sql(items: str) -> str:
    said = "trim(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' || trim(regexp_replace(lower(coalesce(summary, '')), '[^a-z0-9]+', ' ', 'g')))"
    hits = ", ".join("(" + " OR ".join(f"contains(said, '{p}')" for p in listed) + f") AS {k}" for k, listed in PHRASES.items())
    told = "list_filter([" + ", ".join(f"CASE WHEN story_type = '{t}'{f' AND {p}' if p else ''} THEN '{n.replace(chr(39), chr(39) * 2)}' END" for t, p, n in GUARDS) + "], lambda x: x IS NOT NULL)"
    inner = f"SELECT *, {BUCKET} AS bucket, {TYPE} AS story_type, ({NOISE}) AS noise, ({ELIGIBLE}) AS eligible FROM (SELECT *, {hits} FROM (SELECT *, {said} AS said FROM ({items})))"
    return f"SELECT *, {RANK} AS bucket_rank, CASE WHEN len({told}) > 0 THEN {told} ELSE ['{OTHER_NOTE}'] END AS guards FROM ({inner})"
