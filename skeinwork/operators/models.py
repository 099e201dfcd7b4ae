"""Functions that a user may plug in: readers, summary models, translators, card writers. Absent by default."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import col


def answered(inputs: Sequence[Column | str], default: Column, model: Callable[..., str | None] | None = None) -> Column:
    """The model's answer for each row, else the default: where there is no model, no answer or an error."""
    if model is None:
        return default

    def one(*values: str | None) -> str | None:
        try:
            return model(*values)
        except Exception:  # an answer that fails is no answer
            return None

    def many(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([one(*row) for row in frame.itertuples(index=False)], dtype=object)

    return F.coalesce(F.pandas_udf(many, "string")(F.struct(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(inputs)])), default)


def summarised(answer: Column, borderline: Column, default: Column) -> Column:
    """struct(summary, dropped): a model's JSON answer; only a borderline item may be dropped by it."""
    read = F.from_json(answer, "struct<summary:string,decision:string>")
    drop = F.coalesce(borderline & (read["decision"] == "drop"), F.lit(False))
    return F.struct(F.when(~drop, F.coalesce(F.nullif(F.trim(read["summary"]), F.lit("")), default)).alias("summary"), drop.alias("dropped"))


def to_translate(origin: Column | str, delivery: Column | str) -> Column:
    """Whether both languages are known and differ."""
    a, b = (F.lower(F.trim(F.coalesce(col(c), F.lit("")))) for c in (origin, delivery))
    return (a != "") & (b != "") & (a != b)


def translated(text: Column | str, origin: Column | str, delivery: Column | str, model: Callable[..., str | None] | None = None) -> Column:
    """The text in the language of delivery, as far as a translator is given."""
    return F.when(to_translate(origin, delivery), answered([text, origin, delivery], col(text), model)).otherwise(col(text))


def fetched(rows: DataFrame, url: str, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """rows with body and fetch_status of each url; without a reader nothing is fetched."""
    if fetch is None:
        return rows.withColumns({"body": F.lit(None).cast("string"), "fetch_status": F.lit("not_fetched")})

    def many(urls: pd.Series) -> pd.DataFrame:
        out = []
        for u in urls:
            try:
                out.append((fetch(u), "ok"))
            except Exception as e:  # a page that fails is a status, not an error of the job
                out.append((None, f"failed: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["body", "fetch_status"], dtype=object)

    got = F.pandas_udf(many, "struct<body:string,fetch_status:string>").asNondeterministic()(F.col(url))
    return rows.withColumn("_got", got).select(*rows.columns, "_got.*")
