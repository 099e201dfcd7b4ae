"""From raw to normalised items, and hand-made overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import collapse
from skeinwork.functions.urls import host, normalize_url

#: Ranks of sources that report themselves and of those that pass reports on.
DIRECT, INDIRECT = 100, 10
OVERRIDE = "map<string,array<struct<id:string,title:string,url:string,source_id:string,published_ts:timestamp,score:int,summary:string>>>"
OVERRIDE_SCORE = 100


def normalized(raw: DataFrame, sources: DataFrame, clean_snippet: Column | None = None) -> DataFrame:
    """Items with a title, a URL and its host; ids follow from source, URL and title, so reruns agree.

    metadata: external id, parser and tags, then what the source's configuration says, which
    overrides. clean_snippet: an expression over the joined row for sources whose snippets
    need more than blanks collapsed.
    """
    s = sources.select(F.col("id").alias("source_id"), "layer", "is_wrapper", "is_direct_source", "parser", "tags", "extra_config", F.col("priority").alias("source_priority"))
    both = raw.join(F.broadcast(s) if sources.count() <= 10_000 else s, "source_id").withColumns({"title": collapse("title"), "canonical_url": normalize_url(F.trim("url"))})
    both = both.withColumn("domain", host("canonical_url")).filter("title is not null and domain is not null")
    own = F.create_map(F.lit("external_id"), F.col("external_id"), F.lit("parser"), F.col("parser"), F.lit("tags"), F.array_join("tags", ","))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(F.coalesce("extra_config", F.expr("map()").cast("map<string,string>")), k))
    return both.select(
        F.sha2(F.concat_ws("\x1f", "source_id", "canonical_url", "title"), 256).alias("item_id"), "source_id", "canonical_url", "domain", "title",
        (clean_snippet if clean_snippet is not None else collapse("snippet")).alias("text_preview"), "published_ts", "layer", "is_wrapper",
        F.when(F.col("is_direct_source"), DIRECT).otherwise(INDIRECT).alias("directness_rank"), "source_priority",
        F.map_concat(kept, F.coalesce("extra_config", F.expr("map()").cast("map<string,string>"))).alias("metadata"), "tags",
    )


def lookback_hours(source: Column, scope: Column, text: Column, rule: tuple[str, str, str], hours: int = 30, longer: int = 48) -> Column:
    """The default, or the longer one for a source and scope whose text has a term of the rule (source, scope, pattern)."""
    return F.when((source == rule[0]) & (F.lower(F.trim(scope)) == rule[1]) & F.lower(text).rlike(rule[2]), max(hours, longer)).otherwise(hours)


def overrides(lines: DataFrame, week: str) -> DataFrame:
    """Hand-made candidates of a week (value: JSON by week); those without id, title or http(s) URL are left out."""
    c = lines.select(F.explode(F.from_json("value", OVERRIDE)[week]).alias("c")).select("c.*")
    return c.filter("id is not null and title is not null and url rlike '^https?://'").withColumn("score", F.coalesce("score", F.lit(OVERRIDE_SCORE)))
