"""Counters and report rows of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """name, n of each condition, all in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in conditions)
    return one.selectExpr(f"stack({len(conditions)}, {pairs}) AS (name, n)")


def counted(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values by count, most first, then by name."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(n) if n else out


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return counters(df, {f: F.col(f) for f in flags})


def enabled(flags: Sequence[str]) -> Column:
    """Names of the flags that are set, sorted and joined."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))), ", ")


def markdown(df: DataFrame, title: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The report as lines in order: a heading, a table head, a line per row. Meant for report-sized tables."""
    from skeinwork.functions.text import table_cell

    spark = df.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines = spark.createDataFrame(list(enumerate(head)), "line int, text string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[table_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |"))
    from pyspark.sql import Window

    body = df.select((F.row_number().over(Window.orderBy(*order)) + len(head) - 1).alias("line"), row.alias("text"))
    return lines.unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)
