"""Keyed state in plain Parquet: upserts, toggles, cursors, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.rank import best_of


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], at: str, keep: Sequence[str] = ()) -> DataFrame:
    """old with new's rows by key, the latest of several; columns of `keep` stay as they were first."""
    fresh = best_of(new, key, [F.col(at).desc(), *[F.col(c).desc() for c in new.columns if c not in (*key, at)]])
    if keep:
        first = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
        fresh = fresh.join(first, list(key), "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).drop(*[f"_old_{c}" for c in keep])
    return old.join(fresh, list(key), "left_anti").unionByName(fresh.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti").select(*old.columns))


def replace_group(old: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that new has are replaced whole."""
    return old.join(new.select(*group).distinct(), list(group), "left_anti").unionByName(new.select(*old.columns))


def toggled(events: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """State after all toggles: active after an odd number."""
    return events.groupBy(*key).agg((F.count("*") % 2 == 1).alias("active"), F.max(at).alias("changed_at"))


def latest(events: DataFrame, key: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """Last value of each key; maxima combine before the shuffle."""
    return events.groupBy(*key).agg(F.max(F.struct(at, tie, value)).alias("_m")).select(*key, F.col(f"_m.{at}").alias(at), F.col(f"_m.{value}").alias(value))


class Versions:
    """A table as numbered versions in one folder; the highest that is complete is current.

    A version is written under a name of its own and becomes current with its marker, so a
    lost executor or a failed job leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _all(self) -> list[tuple[int, str]]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted((int(n.split("-")[1]), n) for n in names if n.startswith("v-") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self._all()
        return self.spark.read.parquet(f"{self.path}/{found[-1][1]}") if found else None

    def write(self, df: DataFrame) -> DataFrame:
        number = (self._all() or [(0, "")])[-1][0] + 1
        name = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def merge(self, new: DataFrame, key: Sequence[str], at: str, keep: Sequence[str] = ()) -> DataFrame:
        old = self.read()
        return self.write(upsert(old if old is not None else new.limit(0), new, key, at, keep))

    def manifest(self) -> dict[str, int]:
        """Rows of each version."""
        return {n: self.spark.read.parquet(f"{self.path}/{n}").count() for _, n in self._all()}
