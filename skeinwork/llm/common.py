"""Shared folders, table readers and column helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="skeinwork-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local master may go without one: there driver and executors are one process.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


_records: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are stored inside, to be removed when no result is read from them any more."""
    _records.append([])
    try:
        yield _records[-1]
    finally:
        _records.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again.

    This cuts the lineage: what follows reads files that outlive any executor, and a
    non-deterministic column keeps the values that were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    for record in _records:
        record.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[Callable[[], None]] = []


def kept_until_released(forget: Callable[[], None]) -> None:
    """forget: drops what a module keeps between the batches of a task, and needn't between tasks."""
    _kept.append(forget)


def release() -> None:
    """Drop what is kept between batches and give freed memory back to the machine."""
    for forget in _kept:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; a Python worker outlives its task and keeps nothing of it."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def pick(df: DataFrame, name: str, kind: str) -> Column:
    """df's column of that name, cast; a null column if df has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def core(docs: DataFrame) -> DataFrame:
    """Only doc_id and text; whatever else docs has can't clash with an operator's own columns."""
    return docs.select(pick(docs, "doc_id", "long").alias("doc_id"), pick(docs, "text", "string").alias("text"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_blanks(text: Column) -> Column:
    """text without the ASCII blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out
