from __future__ import annotations

import random
from datetime import datetime, timedelta

from skeinwork.operators import relational


def test_newest_before_equals_a_scan(spark):
    """Keys and times may be null, times may tie, one key has most rows."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = lambda n: [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *[start + timedelta(hours=rng.randrange(900))] * 9])) for i in range(n)]
    items, past = rows(150), rows(120)
    kind = "id long, k string, at timestamp"
    got = relational.newest_before(spark.createDataFrame(items, kind).repartition(3), spark.createDataFrame(past, kind), "k", "at", "id", days=2).collect()
    wanted = {i: max(((t, j) for j, h, t in past if h == k and k and at and t and t <= at), default=(None, None))[1] for i, k, at in items}
    assert {r["id"]: r["newest"] and r["newest"]["id"] for r in got} == wanted and len(got) == 150
    assert relational.newest_before(spark.createDataFrame(items, kind), spark.createDataFrame([], kind), "k", "at", "id").filter("newest is not null").count() == 0
