"""Bodies that an ingest job has landed: decoding, retries and mirrors after the fact."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.text import col

#: Attempts that count, seconds that an attempt waits for each before it, and what is tried again.
ATTEMPTS, WAIT, TOO_MANY = 3, 0.5, 429


def charset(content_type: Column | str) -> Column:
    """The charset that a Content-Type names, else utf-8."""
    found = F.regexp_extract(F.lower(F.coalesce(col(content_type), F.lit(""))), r"charset\s*=\s*[\"']?([a-z0-9_.:\-]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("utf-8"))


def _decoded(content: pd.Series, name: pd.Series) -> pd.Series:
    def one(raw: bytes | None, codec: str) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode(codec, "replace")
        except LookupError:  # a charset nobody knows
            return bytes(raw).decode("utf-8", "replace")

    return pd.Series([one(r, c) for r, c in zip(content, name)], dtype=object)


def text_of(content: Column | str, content_type: Column | str) -> Column:
    """Bytes as text; signs that the charset doesn't have are replaced."""
    return F.pandas_udf(_decoded, "string")(col(content), charset(content_type))


def bodies(spark: SparkSession, path: str, content_type: str | None = None) -> DataFrame:
    """path, body of every file in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", text_of("content", F.lit(content_type)).alias("body"))


def first_answers(attempts: DataFrame) -> DataFrame:
    """listing, mirror, attempt, waited, fetch_status of each listing: its first mirror that answered.

    attempts: listing, mirror (in order from 0), attempt (from 1), status (HTTP, null: timeout).
    A mirror is tried ATTEMPTS times, again only after a timeout, 429 or 5xx; then comes the next.
    """
    s = F.col("status")
    answer = F.coalesce(s.between(200, 299), F.lit(False))
    again = s.isNull() | (s == TOO_MANY) | (s >= 500)
    tried = attempts.filter(F.col("attempt") <= ATTEMPTS).groupBy("listing", "mirror").agg(F.min(F.when(answer, F.col("attempt"))).alias("ok"), F.min(F.when(~answer & ~again, F.col("attempt"))).alias("final"), F.max(F.struct("attempt", "status")).alias("last"))
    tried = tried.withColumn("ok", F.when(F.col("final").isNull() | (F.col("ok") < F.col("final")), F.col("ok")))
    best = tried.groupBy("listing").agg(F.min(F.when(F.col("ok").isNotNull(), F.struct("mirror", "ok"))).alias("best"), F.max(F.struct("mirror", "last")).alias("worst"))
    n = F.col("best.ok")
    status = F.when(n.isNotNull(), "ok").otherwise(F.concat(F.lit("failed: "), F.coalesce(F.col("worst.last.status").cast("string"), F.lit("timeout"))))
    return best.select("listing", F.col("best.mirror").alias("mirror"), n.alias("attempt"), (F.lit(WAIT) * n * (n - 1) / 2).alias("waited"), status.alias("fetch_status"))
