"""Facts of stories: only rows that can tell any are read, and rows go from Arrow to Arrow."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skeinwork.functions import extract
from skeinwork.operators import history
from skeinwork.plans.history_queries import _stories_of_orders
from skeinwork.plans.registry import Tables


def test_stories_that_tell_nothing_are_not_read(spark, monkeypatch):
    read = []
    monkeypatch.setattr(extract, "Story", lambda text: read.append(text) or 1 / 0)
    day = dt.date(2024, 1, 2)
    assert extract._funding(False, "$€£", True)("Acme partners with Delta", "", day) is None and extract._funding(False, "$", True)("Acme raises €5m", "", day) is None
    assert extract._funding(True, "$€£", False)("Nothing to see", "", day) is None and extract._deployment("Acme partners with Delta", None, day) is None and extract._deployment("Acme deploys 5 robots", None, None) is None
    assert not read


def test_facts_move_without_pandas_and_stories_without_a_join(spark, sf_dir):
    kept = []
    t = Tables(spark, sf_dir)
    df = spark.range(1).select(F.lit("Acme raises $5 million").alias("t"), F.lit("2024-01-02").alias("d"))
    plans = df.select(extract.funding_key("t", F.lit(""), "d"), extract.deployment_key("t", F.lit(""), "d"))._jdf.queryExecution().toString()
    assert "array(" not in plans
    kept.append(_stories_of_orders(t))
    assert "Join" not in kept[0]._jdf.queryExecution().toString() and kept[0].count() == t.orders.count()


def test_one_probe_of_a_key_tells_both_sides(spark):
    at = dt.datetime(2024, 1, 2)
    kind = "item_id int, event_id string, url string, at timestamp, t string"
    rows = lambda *r: spark.createDataFrame([(i, e, u, at, t) for i, e, u, t in r], kind).withColumns({"funding": extract.funding_key("t", F.lit(""), "at"), "deployment": extract.deployment_key("t", F.lit(""), "at")})
    money, robots = "Acme raises $5 million in Series B", "Acme and Delta Works deploy 1,234 humanoids"
    items = rows((1, "e", "a", ""), (2, None, "s", ""), (3, None, "g", ""), (4, None, "x", money), (5, None, "y", robots), (6, None, "z", ""), (7, None, "g", money))
    sent, shared = rows((11, "e", "s", money), (12, None, "b", robots)), rows((21, None, "s", money), (22, None, "g", robots), (23, "e", "c", ""))
    got = {r["item_id"]: r["reason"] for r in history.suppressed(items, sent, shared).collect()}
    assert got == {1: "event_sent", 2: "url_sent", 3: "group_url", 4: "group_funding", 5: "deployment_sent", 6: None, 7: "group_url"}
