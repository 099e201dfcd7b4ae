"""The choice within a window of scores, folded in the JVM, against the walk in Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skeinwork.operators import rank
from skeinwork.plans.rank_queries import tie_window_representative
from skeinwork.plans.registry import Tables


def test_folded_choice_equals_the_walk(spark):
    rng = random.Random(5)
    rows = [(g, i, float(rng.randrange(30)), rng.random() < 0.5, rng.randrange(3), str(rng.randrange(50))) for g in range(200) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "g int, id int, score double, evidence boolean, at int, url string")
    told = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "score", "evidence", "at", "url"))).alias("rows"))
    got = dict(told.select("g", rank.tie_window_best(F.col("rows"), 5)["id"]).toPandas().itertuples(index=False))
    names = ("g", "id", "score", "evidence", "at", "url")
    assert got == {g: rank.tie_window_choice([dict(zip(names, r)) for r in rows if r[0] == g])["id"] for g in range(200)}


def test_no_python_once_a_customer(spark, sf_dir):
    assert "Pandas" not in tie_window_representative(Tables(spark, sf_dir))._jdf.queryExecution().toString()
