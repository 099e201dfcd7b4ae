"""Stateful operators over a stream of events; each ends in the state that its batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinwork.operators.keyed_table import KeyedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB: it may outgrow memory, and a checkpoint writes its changes only."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def landed(df: DataFrame, folder: str, order: str, times: int, then: Callable[[], object], kind: str = "parquet", columns: tuple[str, ...] = ()) -> None:
    """df as an ingest job lands it: `times` times one after another, by what the whole number `order` leaves modulo `times`; `then` runs after each."""
    for i in range(times):
        df.filter(F.pmod(F.expr(order), F.lit(times)) == i).select(*columns or df.columns).write.mode("append").format(kind).save(folder)
        then()


def forgotten(spark: SparkSession, checkpoint: str) -> None:
    """Takes the last batch's end out of a checkpoint, as a failure before it does: the batch runs again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    ended = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().isdigit()]
    fs.delete(max(ended, key=lambda p: int(p.getName())), False)


def event_stream(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, all that are new or `per_trigger` at once; the checkpoint's offset log is the cursor."""
    files = spark.readStream.schema(like.schema)
    return (files.option("maxFilesPerTrigger", per_trigger) if per_trigger else files).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of each type in tumbling windows; events later than the watermark are left out."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def overlapping(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of each type in windows that start every `step`; an event counts in each that holds it. For tables and streams."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """user_id, start, end (of the last event), n: runs of a user's events with less than `gap` between neighbours. For tables and streams."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = marked.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "end", "n")


class _Last(StatefulProcessor):
    """Keeps the last event of a key: the latest ts, then the largest event_id."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, event_id long, event_type string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        best = tuple(self.last.get()) if self.last.exists() else None
        for pdf in rows:
            for ts, event_id, event_type in zip(pdf["ts"], pdf["event_id"], pdf["event_type"]):
                new = (ts.to_pydatetime(), int(event_id), event_type)
                best = new if best is None or new[:2] > best[:2] else best
        self.last.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "ts": [best[0]], "event_type": [best[2]]})

    def close(self) -> None:
        pass


class _Toggle(StatefulProcessor):
    """Keeps whether a key is active: each of its events turns it on or off."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "active boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        active = bool(self.active.exists() and self.active.get()[0])
        active ^= bool(sum(len(pdf) for pdf in rows) % 2)
        self.active.update((active,))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "active": [active]})

    def close(self) -> None:
        pass


def latest_state(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """user_id, ts, event_type: the last event of each user that a batch has events of.

    A user's state is one value, kept by an aggregate in the JVM; ttl_ms: it is dropped so long after
    its last change (processing time), which bounds the state by the users of that time, takes Python
    once a user and batch, and drained() wants `once` then. To be started in on_disk_state().
    """
    if not ttl_ms:
        last = F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")).alias("last")
        return events.groupBy("user_id").agg(last).select("user_id", "last.ts", "last.event_type")
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return rows.groupBy("user_id").transformWithStateInPandas(_Last(ttl_ms), "user_id long, ts timestamp, event_type string", "Update", "ProcessingTime")


def toggle_states(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """user_id, event_type, active of each key that a batch has events of; ttl_ms as in latest_state(), after which a key is off."""
    keyed = events.select("user_id", "event_type").groupBy("user_id", "event_type")
    if not ttl_ms:
        return keyed.agg((F.count("*") % 2 == 1).alias("active"))
    return keyed.transformWithStateInPandas(_Toggle(ttl_ms), "user_id long, event_type string, active boolean", "Update", "ProcessingTime")


def drained(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update", once: bool = False) -> list[dict]:
    """Runs the stream over what is there now. A batch that is run again after a failure has the same id. What each trigger reports.

    once: all of it in one batch, which state with a time to live needs: its clock alone starts batches without end.
    """
    trigger = {"once": True} if once else {"availableNow": True}
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(each).start()
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


def merged_into(table: KeyedTable, writer: str, at: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that merges every batch into a table, once; a batch that is there already is still read, for its state to be kept."""

    def each(df: DataFrame, batch: int) -> None:
        if table.has(writer, batch):
            df.write.format("noop").mode("append").save()
        else:
            table.merge(df, at, writer, batch)

    return each


class LateSplit:
    """A sink that tells late events from those on time, recovers some and counts all.

    An event is late if it is older than `late` before the latest event of the batches before its
    own; it is recovered if it is no older than `recover` before that, else dropped. What counts
    is added up by window and type. All that a batch writes bears its number, so a batch that
    runs again finds the same marks and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, late: str = "2 days", recover: str = "7 days", width: str = "1 day") -> None:
        self.spark, self.late, self.recover, self.width = spark, late, recover, width
        self.marks = KeyedTable(spark, f"{folder}/marks", ["batch"])
        self.sums = KeyedTable(spark, f"{folder}/sums", ["batch", "start", "event_type"])
        self.told = KeyedTable(spark, f"{folder}/told", ["batch", "status"])

    def __call__(self, df: DataFrame, batch: int) -> None:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        before = self.marks.read()
        high = before.filter(F.col("batch") < batch).agg(F.max("high")).first()[0] if before is not None else None  # one row
        mark = F.lit(high).cast("timestamp")
        status = F.when(mark.isNull() | (F.col("ts") >= mark - F.expr(f"INTERVAL {self.late}")), "on time").when(F.col("ts") >= mark - F.expr(f"INTERVAL {self.recover}"), "recovered").otherwise("dropped")
        marked = df.withColumns({"batch": F.lit(batch).cast("long"), "status": status})
        counts = marked.filter("status <> 'dropped'").groupBy("batch", F.window("ts", self.width)["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        self.sums.merge(counts, writer="late", batch=batch)
        self.told.merge(marked.groupBy("batch", "status").agg(F.count("*").alias("n")), writer="late", batch=batch)
        self.marks.merge(df.agg(F.lit(batch).cast("long").alias("batch"), F.max("ts").alias("high")), writer="late", batch=batch)

    def windows(self) -> DataFrame:
        """start, event_type, n, total of all events that count."""
        return self.sums.read().groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))

    def statuses(self) -> DataFrame:
        """batch, status, n."""
        return self.told.read().select("batch", "status", "n")
