"""What is moved between tasks doesn't grow with the pairs of copies, or with what isn't needed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import functions as F

from skeinwork.operators import digest, history, relational, resolve
from skeinwork.sources import feeds
from skeinwork.sources.listings import article_date
from skeinwork.streaming import streams


def shuffled(spark, run: Callable[[], object]) -> float:
    """MB that run writes for other tasks to read."""
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        told = sc.statusStore().executorList(True)
        return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))

    before = written()
    run()
    return (written() - before) / 1e6


def titles(spark, n: int, prefix: str):
    """Copies of one title and others that share some of its words; all at one time."""
    words = F.when(F.col("id") % 10 == 0, F.concat(F.lit("alpha beta gamma word"), F.col("id"))).otherwise("alpha beta gamma delta")
    return spark.range(n).select("id", words.alias("title"), F.concat(F.lit(prefix), "id").alias("url"), F.lit(None).cast("timestamp").alias("at"), F.col("id").alias("order"))


def test_event_ids_of_many_copies_list_no_pairs(spark):
    current, past = titles(spark, 1500, "c"), titles(spark, 1500, "h").withColumn("event_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("e"), "id")))
    got = []
    assert shuffled(spark, lambda: got.extend(resolve.event_ids(current, past).collect())) < 5
    assert len(got) == 1500 and {(r["event_id"], r["known"]) for r in got} == {("e0", True)}


def test_similar_titles_are_measured_once_and_listed_whole(spark):
    got, n = [], 1200
    assert shuffled(spark, lambda: got.append(resolve.similar_pairs(titles(spark, n, "u"), "id", "title").agg(F.count("*"), F.sum(F.col("b") - F.col("a")), F.min(F.col("b") - F.col("a"))).first())) < 3
    assert tuple(got[0]) == (n * (n - 1) // 2, n * (n * n - 1) // 6, 1)


def test_ids_alone_are_moved_to_be_listed(spark):
    got, n, copies = [], 12_000, 1500
    items = spark.range(n).select("id", F.concat(F.lit("alpha beta gamma solo"), (F.col("id") / copies).cast("long")).alias("title"))
    assert shuffled(spark, lambda: got.append(resolve.similar_pairs(items, "id", "title").count())) < 1.6
    assert got == [n * (n - 1) // 2]


def test_rows_of_one_id_or_none_make_no_pair(spark):
    rows = [(1, "alpha beta gamma one"), (1, "alpha beta gamma two"), (None, "alpha beta gamma one"), (2, "alpha beta gamma one"), (None, "alpha beta gamma"), (2, "alpha beta gamma one")]
    out = resolve.similar_pairs(spark.createDataFrame(rows, "id long, title string"), "id", "title")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 0.75)] * 2 + [(1, 2, 1.0)] * 2


def test_titles_are_measured_by_compiled_code(spark):
    sets = spark.createDataFrame([(1, ["alpha", "beta", "gamma", "delta"], 1), (2, ["alpha", "beta", "gamma", "word"], 2), (3, ["alpha", "more", "gamma", "word"], 3)], "id long, tokens array<string>, group long")
    out = resolve.alike(sets)
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0.75), (2, 3, 0.75)}
    measured = [line for line in plan(out).split("\n") if "array_intersect" in line]
    assert measured and not any("lambdafunction" in line for line in measured)


def test_a_week_moves_few_of_its_rows(spark):
    i, got = F.col("id"), []
    c = spark.range(40_000).select(F.lit("w").alias("week"), "id", F.concat(F.lit("https://o.example.org/"), i).alias("url"), F.concat(F.lit("order "), i).alias("title"), (i % 9000).cast("string").alias("story"), F.concat((i % 5).cast("string"), F.lit("-x")).alias("bucket"),
                                   (i % 2 == 0).alias("sent"), (i % 9001 == 0).alias("manual"), (i % 13 == 0).alias("noise"), F.lit(0).alias("signal"), F.pmod(F.hash("id"), F.lit(1000)).alias("score"))
    assert shuffled(spark, lambda: got.extend(digest.weekly(c, 20, ("4-x", "3-x", "2-x", "1-x", "0-x"), (), F.col("signal")).collect())) < 5
    assert len(got) == 20 and {r["week"] for r in got} == {"w"}


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_large_tables_of_clusters_do_not_go_through_the_driver(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(relational, "SMALL_ROWS", 50)
    items = titles(spark, 200, "u").withColumn("title", F.concat("title", F.lit(" at place"), F.col("id") % 90))
    out = resolve.cluster(items, "id", "title", "url", "at", "order")
    assert "Join" in plan(out) and "Broadcast" not in plan(out)
    rows = [r.asDict() for r in items.collect()]
    base = pd.DataFrame([{"id": r["id"], "order": r["order"], "url": r["url"], "at": pd.NaT, "tokens": [w for w in r["title"].split() if w != "at"], "key": "-".join([w for w in r["title"].split() if w != "at"][:6])} for r in rows])
    assert {r["id"]: r["cluster"] for r in out.collect()} == dict(resolve.fold_clusters(base).itertuples(index=False))


def test_state_without_time_to_live_stays_in_the_jvm(spark):
    events = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert "TransformWithState" not in plan(streams.toggle_states(events)) + plan(streams.latest_state(events))


def test_a_page_is_read_once_for_its_date(spark):
    pages = spark.createDataFrame([('<meta name="date" content="3 Mar 2024 10:00">',)], "body string").select(article_date(F.col("body"), F.lit("en")).alias("at"))
    assert pages.first()["at"] == datetime(2024, 3, 3, 10)
    assert pages._jdf.queryExecution().analyzed().toString().count("<meta") == 1


def test_only_the_keys_that_are_asked_for_are_read(spark):
    items = spark.createDataFrame([("Acme raises $5 million in Series B", None, datetime(2024, 1, 2))], "title string, preview string, at timestamp")
    assert history.keyed(items, "title", "preview", "at", ("funding",)).columns == ["title", "preview", "at", "funding"]


def test_feeds_take_one_kind_of_python_worker(spark):
    feed = "<rss><channel><item><title>A &amp;amp; B</title><link>https://a.org</link><description>&lt;p&gt;x&lt;/p&gt;</description></item></channel></rss>"
    out = feeds.rss_items(spark.createDataFrame([("s", feed)], "source_id string, body string"))
    assert "ArrowEvalPython" not in plan(out)
    assert [(r["title"], r["snippet"]) for r in out.collect()] == [("A & B", "x")]
