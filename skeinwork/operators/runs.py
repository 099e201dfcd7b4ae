"""Runs and what they leave: lifecycle, settings, diagnostics, snapshots, overrides."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.state import Versions, upsert

SECRET = ("token", "key", "secret", "password")


def settings_snapshot(settings: Mapping, secret: Sequence[str] = SECRET) -> str:
    """Settings as JSON with sorted keys; values whose name tells of a secret are masked, at any depth."""

    def shown(name: str, value: object) -> object:
        if isinstance(value, Mapping):
            return {str(k): shown(str(k), v) for k, v in value.items()}
        if any(s in name.lower() for s in secret) and value not in (None, ""):
            return "***"
        return [shown(name, v) for v in value] if isinstance(value, (list, tuple)) else value

    return json.dumps(shown("", settings), sort_keys=True, default=str)


class Runs:
    """A table of runs: started, then completed or failed."""

    SCHEMA = "run_id string, kind string, status string, started_at timestamp, changed_at timestamp, settings string, note string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, Versions(spark, path)

    def _put(self, run_id: str, kind: str, status: str, settings: str | None, note: str | None) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = self.spark.createDataFrame([(run_id, kind, status, now, now, settings, note)], self.SCHEMA)
        self.table.merge(row, ["run_id"], "changed_at", keep=["started_at", "settings"])

    @contextmanager
    def running(self, kind: str, settings: Mapping) -> Iterator[str]:
        """A run's id; the run is completed at the end, failed on an error, which goes on."""
        run_id, shown = uuid.uuid4().hex, settings_snapshot(settings)
        self._put(run_id, kind, "started", shown, None)
        try:
            yield run_id
        except BaseException as e:
            self._put(run_id, kind, "failed", shown, f"{type(e).__name__}: {e}"[:500])
            raise
        self._put(run_id, kind, "completed", shown, None)


def merged_maps(*maps: Column) -> Column:
    """One map of several; of a key that several have the last one's value counts, null maps don't."""

    def two(a: Column, b: Column) -> Column:
        a, b = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (a, b))
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, maps)


def diagnostics(review: Column, card: Column, sources: Column) -> Column:
    """What a run notes of an item: its review, its card and where it comes from, by prefixed keys."""
    named = lambda m, p: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit(f"{p}."), k))
    return merged_maps(named(review, "review"), named(card, "card"), named(sources, "source"))


def content(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of a table's content in which their order doesn't count."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    r = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    return r["n"], f"{(r['x'] or 0) & (1 << 64) - 1:016x}{r['s'] or 0:x}"


def snapshot(tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Tables written under path with a manifest of their rows and digests."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows.append((name, *content(spark.read.parquet(f"{path}/{name}"))))
    spark.createDataFrame(rows, "name string, n long, digest string").coalesce(1).write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def restored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A snapshot's tables; an error if one isn't what the manifest says."""
    out = {}
    for r in spark.read.parquet(f"{path}/_manifest").collect():
        out[r["name"]] = spark.read.parquet(f"{path}/{r['name']}")
        if content(out[r["name"]]) != (r["n"], r["digest"]):
            raise ValueError(f"{r['name']} differs from its manifest")
    return out


def upsert_surviving(old: DataFrame, new: DataFrame, key: str, row_id: str, at: str) -> tuple[DataFrame, DataFrame]:
    """old with new's rows by key, and (key, id) of each of new's keys: an id that a key has had survives."""
    known = old.groupBy(key).agg(F.min(row_id).alias("_known"))
    kept = new.join(known, key, "left").withColumn(row_id, F.coalesce("_known", row_id)).drop("_known")
    ids = kept.groupBy(key).agg(F.min(row_id).alias(row_id))
    kept = kept.drop(row_id).join(ids, key).select(*old.columns)
    return upsert(old, kept, [key], at), ids


def overridden(tables: Mapping[str, DataFrame], overrides: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Tables with manual picks: items, events, members, decisions and candidates get or keep a row of each.

    overrides: week, url, title, summary, score. An item is known by its url, an event by its
    item; ids of new ones follow from the url, so a pick that is made again changes nothing.
    """
    known = tables["items"].groupBy("url").agg(F.min("item_id").alias("_item"))
    event = tables["members"].groupBy(F.col("item_id").alias("_item")).agg(F.min("event_id").alias("_event"))
    picks = overrides.join(known, "url", "left").join(event, "_item", "left")
    new_id = lambda kind: F.sha2(F.concat(F.lit(f"{kind}:"), "url"), 256)
    picks = picks.select("week", "url", "title", "summary", "score", F.coalesce("_item", new_id("item")).alias("item_id"), F.coalesce("_event", new_id("event")).alias("event_id"), at.alias("at"), F.lit("manual").alias("status"))
    keys = {"items": ["item_id"], "events": ["event_id"], "members": ["event_id", "item_id"], "decisions": ["item_id"], "candidates": ["week", "event_id"]}
    out = {}
    for name, key in keys.items():
        old = tables[name]
        rows = picks.dropDuplicates(key).select(*[F.col(c) if c in picks.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        out[name] = upsert(old, rows, key, "at")
    return out
