from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import digest, rank, reviews


def row(i, bucket="a", sent=False, manual=False, noise=False, title=None, story=None):
    return {"id": i, "url": f"https://x.org/{i}", "title": title or f"title {i}", "story": story, "bucket": bucket, "sent": sent, "manual": manual, "noise": noise}


def ids(rows):
    return [r["id"] for r in rows]


def test_manual_first_then_quota_sent_before_stored():
    rows = [row(1), row(2, "b", sent=True), row(3, "a", sent=True), row(4, "b"), row(5, "c", manual=True), row(6, "a", sent=True)]
    assert ids(digest.prepare(rows, 20, ("b", "a"), ())) == [5, 2, 3, 6, 1, 4]


def test_stored_only_fill_up_to_five():
    rows = [row(i, sent=i <= 6) for i in range(1, 10)]
    assert ids(digest.prepare(rows, 20, (), ())) == [1, 2, 3, 4, 5, 6]


def test_repeats_noise_and_weak_buckets():
    rows = [row(1, sent=True), row(2, sent=True, title=" Title  1"), row(3, sent=True, noise=True), row(4, "w", sent=True), row(5, sent=True, story="s"), row(6, sent=True, story="s")]
    assert ids(digest.prepare(rows, 20, (), ("w",))) == [1, 5, 4]


def test_ineligible_ones_are_no_candidates_and_sent_ones_come_first():
    rows = [row(1, "a"), row(2, "a", sent=True) | {"eligible": False}, row(3, "b", sent=True), row(4, "a", manual=True) | {"eligible": False}, row(5, "b")]
    assert ids(digest.prepare(rows, 20, ("a", "b"), ())) == [1, 3, 5]
    assert ids(digest.sent_first(rows, 20, ("a", "b"), ())) == [3, 1, 5]
    assert ids(digest.sent_first(rows, 2, ("a", "b"), ())) == [3, 1]


def test_select_distinct():
    rows = [row(1), row(2), row(3, manual=True), row(4), row(5), row(6)]
    assert ids(digest.select_distinct(rows, [5, 99, 1], 4)) == [3, 5, 1, 2]


def test_large_bucket_leaves_the_others_their_picks(spark):
    rows = [row(i, "a", sent=True, story="s" if i % 7 else None) for i in range(900)] + [row(1000 + i, b, sent=i % 2 == 0) for i, b in enumerate("bcbcb")]
    rows = [r | {"week": "w", "signal": 0, "score": r["id"]} for r in rows]
    df = spark.createDataFrame(rows, "week string, id long, url string, title string, story string, bucket string, sent boolean, manual boolean, noise boolean, signal int, score long")
    ranks = F.when(F.col("bucket") == "a", 0).when(F.col("bucket") == "b", 1).otherwise(2)
    got = [int(r["id"]) for r in digest.weekly(df, 20, ("a", "b", "c"), (), ranks).orderBy("place").collect()]
    ordered = sorted(rows, key=lambda r: ("abc".index(r["bucket"]), not r["sent"], -r["score"], r["id"]))
    assert got == ids(digest.prepare(ordered, 20, ("a", "b", "c"), ())) and got[1:3] == [1004, 1003]


@pytest.mark.parametrize("stored_last", [False, True])
def test_weeks_equal_the_choice_over_all_their_rows(spark, stored_last):
    """Skewed weeks, with repeats by every key, against a fold over each whole week."""
    rng = random.Random(stored_last)
    rows = []
    for i in range(500):
        few = rng.random() < 0.6
        r = row(i, rng.choice("aaabcdw"), rng.random() < 0.3, rng.random() < 0.02, rng.random() < 0.2, f"Title {rng.randrange(30 if few else 900)}", rng.choice([None, "", f"s{rng.randrange(40)}"]))
        r["url"] = f" https://X.org/{rng.randrange(60 if few else 900)}"
        rows.append(r | {"week": rng.choice(["v", "w", "w", "w", f"u{i % 20}"]), "signal": rng.randrange(2), "score": rng.randrange(50), "eligible": rng.random() < 0.95})
    df = spark.createDataFrame(rows, "week string, id long, url string, title string, story string, bucket string, sent boolean, manual boolean, noise boolean, signal int, score long, eligible boolean").repartition(3)
    bucket = F.ascii("bucket")
    limit, preferred, weak = 8, ("d", "c", "b", "a"), ("w",)
    got = {}
    for r in digest.weekly(df, limit, preferred, weak, bucket, stored_last).orderBy("place").collect():
        got.setdefault(r["week"], []).append(int(r["id"]))
    wanted = {}
    for week in {r["week"] for r in rows}:
        own = [r for r in rows if r["week"] == week and r["eligible"]]
        own.sort(key=lambda r: (not r["manual"], ord(r["bucket"]), not r["sent"], -r["signal"], -r["score"], r["id"]))
        chosen = ids((digest.sent_first if stored_last else digest.prepare)(own, limit, preferred, weak))
        if chosen:
            wanted[week] = chosen
    assert got == wanted and len(got["w"]) == limit


def test_rounds_equal_a_fold(spark):
    """First sight by any of several keys, with a key that a third of all rows share and long chains."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", None, "", f"a{rng.randrange(60)}"]), f"b{rng.randrange(90)}", rng.choice("xy")) for i in range(300)]
    rows += [(1000 + i, f"c{i}", f"d{i + 1}" if i % 2 else f"d{i}", "z") for i in range(12)] + [(2000 + i, f"e{(i + 1) // 2}", f"f{i // 2}", "z") for i in range(12)] + [(3000, None, None, "z"), (3001, "", None, "z")]
    df = spark.createDataFrame(rows, "id long, a string, b string, g string").repartition(4)
    seen, wanted = set(), []
    for i, a, b, g in rows:
        keys = {(g, k, v) for k, v in (("a", a), ("b", b)) if v}
        if not keys & seen:
            seen |= keys
            wanted.append(i)
    assert sorted(r["id"] for r in rank.first_seen_any(df, "id", [], [F.col("a"), F.col("b")], [F.col("g")]).collect()) == wanted
    assert rank.first_seen_any(df.limit(0), "id", [], [F.col("a")]).count() == 0


def test_first_few_are_those_of_all_rows(spark):
    """Groups whose first rows are repeats again and again, chains of repeats across parts, parts that only rows far down have."""
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), rng.choice(["p", "p", "q", None]), 1000 - i, f"a{rng.randrange(80)}", rng.choice([None, "", f"b{rng.randrange(40)}"])) for i in range(200)]
    rows += [(1000 + i, "many", "p", 1000 - i, "one", None) for i in range(10)] + [(1300 + i, "many", "q" if i else "p", 500 - i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(8)]
    rows += [(2000 + i, "chain", "p" if i < 12 else "q", 500 - i, f"e{i // 2}", f"f{(i + 1) // 2}") for i in range(16)]
    df = spark.createDataFrame(rows, "id long, g string, part string, best long, a string, b string").repartition(3)
    wanted, kept = set(), {}
    seen = set()
    for i, g, part, _, a, b in sorted(rows, key=lambda r: (-r[3], r[0])):
        keys = {(g, k, v) for k, v in (("a", a), ("b", b)) if v}
        if not keys & seen:
            seen |= keys
            n = kept[g] = kept.get(g, 0) + 1
            if n <= 2 or (part and (g, part) not in kept):
                wanted.add(i)
            kept[g, part] = True
    got = [r["id"] for r in rank.first_few_seen_any(df, "best", ["id"], [F.col("a"), F.col("b")], ["g"], 2, "part").collect()]
    assert len(got) == len(wanted) and set(got) == wanted and {1000, 1300} <= wanted


@pytest.mark.parametrize("answer, wanted", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": "}"}\n```', '{"a": "}"}'), ('Sure: {"a": {"b": 1}} done', '{"a": {"b": 1}}'), ('{"a": 1} {"b": 2}', None), ("none", None), (None, None), ("[1]", None),
])
def test_json_object(answer, wanted):
    assert reviews.json_object(answer) == wanted


def test_medium_promotions_need_an_edited_card(spark):
    told = lambda decision, confidence, **more: json.dumps({"decision": decision, "confidence": confidence, **more})
    card = {"edited_title": "T", "edited_summary": "S."}
    cases = [
        (told("promote", "medium", **card), True, "promoted"), (told("promote", "medium", **card), False, "unchanged"), (told("promote", "medium"), True, "unchanged"),
        (told("promote", "medium", edited_title="T", edited_summary=" "), True, "unchanged"), (told("promote", "high"), False, "promoted"), (told("reject", "medium", **card), True, "unchanged"), ("no answer", True, "not_reviewed"),
    ]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(cases)], "i int, answer string, promotable boolean")
    got = df.select("i", reviews.outcome(reviews.review(F.col("answer")), F.lit(False), F.col("promotable")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [c[2] for c in cases]


def test_memory_context_has_active_rules_of_a_scope(spark):
    rules = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(a).alias("active"), F.array(*map(F.lit, s)).alias("scopes")) for t, a, s in (("one", True, ["x", "y"]), ("off", False, ["x"]), ("other", True, ["y"]))])
    got = spark.range(1).select(reviews.memory_context(rules, F.array(*[F.lit(f"e{i}") for i in range(4)]), "x", 2).alias("c")).first()["c"]
    assert got == "- one\n* e0\n* e1"
