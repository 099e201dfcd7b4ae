"""A keyed table whose merges write what changed, and nothing else."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators.rank import best_of

#: Merges that may wait in a table before they are rewritten into one, and commits that are kept.
WAITING, KEPT = 16, 8
TRIES = 20
_LOCAL = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has committed first, and what it changed can't be joined with this."""


class KeyedTable:
    """Rows by key in a folder that all executors share, as the parts that commits name.

    A merge writes the rows of its batch as a part of its own, dealt by the key's hash into
    `buckets` folders, and then a commit: a small file that lists the parts. Commits are numbered
    and get their number only if it is free, so of two writers one has to read what the other
    committed and try again with the next number; parts never clash, so neither loses a row.
    A key's rows are those of the last commit that has the key; a commit may also tell that keys
    are gone. A merge with a (writer, batch) that has been committed does nothing, so a batch that
    is run again after a failure changes nothing. After WAITING merges, a compaction rewrites the
    parts into one; vacuum() removes folders that no kept commit names.

    several: a key has any number of rows, and a batch replaces them all. keep: columns that stay
    as they were when the key was first written. A null in a key is a key of its own.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], keep: Sequence[str] = (), several: bool = False, buckets: int = 8) -> None:
        self.spark, self.path, self.key, self.keep, self.several, self.buckets = spark, path.rstrip("/"), list(key), list(keep), several, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        fs = spark._jvm.org.apache.hadoop.fs
        self._files = fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.path)).toUri(), conf)
        kind = getattr(fs, "Options$Rename")
        self._plain = spark.sparkContext._gateway.new_array(kind, 1)
        self._plain[0] = kind.NONE

    # Commits

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def commits(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json")]

    def state(self, number: int | None = None) -> dict:
        """number, parts (name, number of the commit that wrote it), schema and batches (by writer, the last) of a commit, the last one if none is named."""
        last = number if number is not None else max(self.commits(), default=0)
        if not last:
            return {"number": 0, "parts": [], "batches": {}, "schema": None}
        stream = self._fs.open(self._path(f"{self.path}/commits/{last:010d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {"number": last, **json.loads(text)}

    def _commit(self, number: int, state: dict) -> bool:
        """Whether this commit got its number: a rename that doesn't overwrite lets one writer through."""
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({k: state[k] for k in ("parts", "batches", "schema")}).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        try:
            with _LOCAL:  # a local folder's rename looks first and renames then
                self._files.rename(draft, self._path(f"{self.path}/commits/{number:010d}.json"), self._plain)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    # Reading

    def _rows(self, state: dict) -> DataFrame | None:
        """All rows that wait in the parts, with the number of their commit."""
        if not state["parts"]:
            return None
        schema = self.spark.createDataFrame([], state["schema"]).schema
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/parts/{name}").withColumn("_commit", F.lit(number).cast("long")) for name, number in state["parts"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table as of a commit; None before the first."""
        found = self._current(self.state(number))
        return found.filter("not _gone").drop("_gone", "_bucket", "_commit", *[f"_first_{c}" for c in self.keep]) if found is not None else None

    def _current(self, state: dict) -> DataFrame | None:
        rows = self._rows(state)
        if rows is None or len(state["parts"]) == 1:
            return rows
        own = Window.partitionBy("_bucket", *self.key)
        last = rows.withColumn("_last", F.max("_commit").over(own))
        for c in self.keep:
            # A key that was gone in between starts anew.
            since = F.coalesce(F.max(F.when(F.col("_gone"), F.col("_commit"))).over(own), F.lit(-1))
            born = F.min(F.when(F.col("_commit") > since, F.struct("_commit", F.col(c).alias("v")))).over(own)
            last = last.withColumn(f"_kept_{c}", F.coalesce(born["v"], F.col(c)))
        last = last.filter("_commit = _last").drop("_last")
        for c in self.keep:
            last = last.withColumn(c, F.col(f"_kept_{c}")).drop(f"_kept_{c}")
        return last

    # Writing

    def _write(self, rows: DataFrame, name: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumn("_bucket", bucket)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/parts/{name}")

    def has(self, writer: str, batch: int) -> bool:
        """Whether the writer's batch has been committed."""
        return self.state()["batches"].get(writer, -1) >= batch

    def _put(self, rows: DataFrame, writer: str | None, batch: int | None) -> int:
        state = self.state()
        if writer is not None and batch is not None and state["batches"].get(writer, -1) >= batch:
            return state["number"]
        name = uuid.uuid4().hex
        self._write(rows, name)
        schema = rows.withColumn("_bucket", F.lit(0)).schema
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        for _ in range(TRIES):
            number = state["number"] + 1
            batches = state["batches"] | ({writer: batch} if writer is not None and batch is not None else {})
            if self._commit(number, {"parts": [*state["parts"], [name, number]], "batches": batches, "schema": state["schema"] or kinds}):
                if len(state["parts"]) + 1 > WAITING:
                    self.compact()
                return number
            state = self.state()
            if writer is not None and batch is not None and state["batches"].get(writer, -1) >= batch:
                return state["number"]
        raise Conflict(f"no commit in {TRIES} tries")

    def merge(self, batch_rows: DataFrame, at: str | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Upserts rows by key; of several rows of a key the latest `at` counts, then the largest row (several: all). The commit's number."""
        if not self.several:
            rest = [F.col(f"`{c}`").desc_nulls_last() for c in batch_rows.columns if c not in (*self.key, at)]
            batch_rows = best_of(batch_rows, self.key, [*([F.col(at).desc_nulls_last()] if at else []), *rest] or [F.lit(1)])
        return self._put(batch_rows.withColumn("_gone", F.lit(False)), writer, batch)

    def delete(self, keys: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        state = self.state()
        if not state["schema"]:
            return state["number"]
        like = self.spark.createDataFrame([], state["schema"]).drop("_bucket", "_gone").schema
        gone = keys.select(*self.key).distinct().select(*[(F.col(f"`{f.name}`") if f.name in self.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in like])
        return self._put(gone.withColumn("_gone", F.lit(True)), writer, batch)

    def compact(self) -> int | None:
        """Rewrites the parts that are there now into one; merges that commit meanwhile stay as they are."""
        state = self.state()
        old = [tuple(p) for p in state["parts"]]
        if len(old) < 2:
            return None
        name, upto = uuid.uuid4().hex, max(n for _, n in old)
        self._write(self._current(state).filter("not _gone").drop("_bucket", "_commit"), name)
        for _ in range(TRIES):
            now = [tuple(p) for p in state["parts"]]
            if not set(old) <= set(now):
                return None  # another compaction was first
            number = state["number"] + 1
            if self._commit(number, {**state, "parts": [[name, upto], *[list(p) for p in now if p not in old]]}):
                return number
            state = self.state()
        return None

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Removes commits but the last `kept`, and parts that only those name; parts of merges that aren't committed yet stay for the next time if they are younger than the oldest kept commit."""
        numbers = self.commits()
        named = {name for n in numbers[-kept:] for name, _ in self.state(n)["parts"]}
        once = {name for n in numbers[:-kept] for name, _ in self.state(n)["parts"]}
        gone = sorted(once - named)
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/parts/{name}"), True)
        for n in numbers[:-kept]:
            self._fs.delete(self._path(f"{self.path}/commits/{n:010d}.json"), False)
        return gone

    def written(self) -> dict[str, int]:
        """Bytes of each part."""
        return {n: self._fs.getContentSummary(self._path(f"{self.path}/parts/{n}")).getLength() for n in self._names("parts")}
