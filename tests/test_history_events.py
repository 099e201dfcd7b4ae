"""Ids of events that history tells, against a walk over clusters in order."""

from __future__ import annotations

import random

import pytest

from skeinwork.operators import resolve

KIND = "id long, title string, url string, at timestamp, order long"
WORDS = "timber tower robot crane bridge school housing permit factory merger supplier valuation".split()


def alike(a, b):
    x, y = ({w for w in r[1].lower().split() if len(w) > 2} for r in (a, b))
    return a[2] == b[2] or a[1].lower().split()[:6] == b[1].lower().split()[:6] or (bool(x and y) and len(x & y) / min(len(x), len(y)) >= 0.75)


def by_hand(current, history):
    clusters = []
    for r in current:
        home = next((c for c in clusters if any(alike(r, o) for o in c)), None)
        home.append(r) if home is not None else clusters.append([r])
    groups = {}
    for r in history:
        groups.setdefault(r[5] or ("row", r[0]), []).append(r)
    out = {}
    for c in clusters:
        found = next((g for g in groups if any(alike(r, h) for r in c for h in groups[g])), None)
        for r in c:
            out[r[0]] = found if found is not None else ("new", c[0][0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_events_of_history(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (i, " ".join(rng.sample(WORDS, rng.choice([2, 3, 4]))), f"u{rng.randrange(60)}", None, i)
    history = [(*row(i), rng.choice([None, None, f"e{rng.randrange(6)}"])) for i in range(25)]
    current = [row(100 + i) for i in range(25)]
    got = {r["id"]: r for r in resolve.event_ids(spark.createDataFrame(current, KIND), spark.createDataFrame(history, f"{KIND}, event_id string")).collect()}
    wanted = by_hand(current, history)
    assert all(got[i]["known"] == isinstance(w, str) and (not isinstance(w, str) or got[i]["event_id"] == w) for i, w in wanted.items())
    same = lambda told: {frozenset(i for i in told if told[i] == e) for e in told.values()}
    assert same({i: r["event_id"] for i, r in got.items()}) == same(wanted)
    assert any(isinstance(w, tuple) and w[0] == "row" for w in wanted.values())
