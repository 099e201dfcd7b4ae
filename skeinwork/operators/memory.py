"""Editorial memory: examples with feedback, rules and presets; what is known is kept by fingerprint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.audit import counted
from skeinwork.operators.runs import upsert_surviving
from skeinwork.operators.state import Versions

EXAMPLE = "id string, kind string, title string, feedback string, source string, url string, week string, stage string, tags array<string>, rule_ids array<string>, status string, fingerprint string, at timestamp"


def slug(c: Column) -> Column:
    """Letters and digits in lower case, all else as one underscore."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]), 256)


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")


def writer_examples(spark: SparkSession, path: str, rules: Mapping[str, Sequence[str]], source: str = "writer_examples") -> DataFrame:
    """Examples of digests from a JSON array of label, headline, body_html, notes.

    label good is a digest_good, any other a digest_bad; notes become tags; rules: ids by label.
    """
    raw = spark.read.schema("label string, headline string, body_html string, notes array<string>").option("multiLine", True).json(path)
    label = F.lower(F.trim("label"))
    good = label == "good"
    notes = F.transform(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.trim(n) != ""), lambda n: slug(n))
    ids = lambda k: F.array(*map(F.lit, rules.get(k, ()))).cast("array<string>")
    mark = fingerprint(F.lit(source), label, F.trim("headline"), F.trim("body_html"))
    return raw.select(
        mark.alias("id"), F.when(good, "digest_good").otherwise("digest_bad").alias("kind"), F.trim("headline").alias("title"), F.trim("body_html").alias("feedback"), F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("week"), F.lit("digest_writer").alias("stage"), F.concat(F.array(F.concat(F.lit("digest_example:"), label)), notes).alias("tags"),
        F.when(good, ids("good")).otherwise(ids("bad")).alias("rule_ids"), F.lit("accepted").alias("status"), mark.alias("fingerprint"), _now().alias("at"),
    )


def manual_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples from a JSON array with their own kinds; what isn't an object is left out."""
    kind = "kind string, title string, feedback_text string, source string, url string, week_key string, pipeline_stage string, decision_tags array<string>, linked_rule_ids array<string>, resolution_status string, source_fingerprint string"
    listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("one"))
    raw = listed.select(F.from_json("one", kind).alias("e")).select("e.*").filter("kind is not null and title is not null")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    mark = F.coalesce(own("source_fingerprint"), fingerprint(F.col("kind"), F.col("title"), F.col("feedback_text")))
    return raw.select(
        mark.alias("id"), F.trim("kind").alias("kind"), F.trim("title").alias("title"), F.trim("feedback_text").alias("feedback"), own("source").alias("source"), own("url").alias("url"), own("week_key").alias("week"),
        own("pipeline_stage").alias("stage"), clean("decision_tags").alias("tags"), clean("linked_rule_ids").alias("rule_ids"), F.coalesce(own("resolution_status"), F.lit("accepted")).alias("status"), mark.alias("fingerprint"), _now().alias("at"),
    )


def configured(path: str, key: str) -> list[dict]:
    """The list or mapping under `key` of a YAML file; an error without it."""
    import yaml

    payload = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if key not in payload:
        raise ValueError(f"{path} has no '{key}'")
    listed = payload[key]
    return [{"id": k, **(v or {})} for k, v in listed.items()] if isinstance(listed, dict) else list(listed)


class Memory:
    """The table of examples; an example that is added again keeps its id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, Versions(spark, path)

    def examples(self) -> DataFrame:
        found = self.table.read()
        return found if found is not None else self.spark.createDataFrame([], EXAMPLE)

    def add(self, new: DataFrame) -> DataFrame:
        """(fingerprint, id) of what was added."""
        rows, ids = upsert_surviving(self.examples(), new, "fingerprint", "id", "at")
        self.table.write(rows)
        return ids

    def add_one(self, kind: str, title: str, feedback: str, tags: Sequence[str] = (), rule_ids: Sequence[str] = (), **other: str | None) -> DataFrame:
        row = (None, kind, title, feedback, other.get("source"), other.get("url"), other.get("week"), other.get("stage"), list(tags), list(rule_ids), other.get("status") or "accepted", None, None)
        mark = fingerprint(F.col("kind"), F.col("title"), F.col("feedback"))
        return self.add(self.spark.createDataFrame([row], EXAMPLE).withColumns({"fingerprint": mark, "id": mark, "at": _now()}))

    def listed(self, kind: str | None = None, status: str | None = None, n: int = 50) -> DataFrame:
        out = self.examples()
        for column, value in (("kind", kind), ("status", status)):
            out = out.filter(F.col(column) == value) if value else out
        return out.orderBy(F.desc("at"), "id").limit(n)

    def summary(self) -> dict[str, DataFrame]:
        """Counts by kind and status, and the ten most frequent tags."""
        e = self.examples()
        return {"kind": counted(e, "kind"), "status": counted(e, "status"), "tags": counted(e.select(F.explode("tags").alias("tag")), "tag", 10)}
