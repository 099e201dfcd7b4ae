from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import dates, extract, text, urls
from skeinwork.operators import rank, relational, resolve, reviews, rules, state, summary
from skeinwork.sources import feeds, pages, registry


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, wanted", [
    ("https://A.org/p/?utm_source=x&b=1&a=&b=2#top", "https://A.org/p/?b=1&a=&b=2"), ("https://a.org/?FBCLID=1", "https://a.org/"), ("https://a.org/p", "https://a.org/p"), ("https://a.org/p?q=a%20b", "https://a.org/p?q=a+b"),
])
def test_normalize_url(spark, url, wanted):
    assert one(spark, urls.normalize_url("u"), u=url) == wanted
    assert one(spark, urls.normalize_url("u"), u=wanted) == wanted


def test_url_keys(spark):
    assert one(spark, urls.url_key("u"), u="HTTPS://A.org/Path/#x") == "https://a.org/Path"
    assert one(spark, urls.url_key("u"), u="https://a.org/?q=1") == "https://a.org/?q=1"
    assert one(spark, urls.canonical_url("u"), u="https://a.org/p/") == "https://a.org/p"
    assert one(spark, urls.external_id("u"), u="https://a.org/x/y-1/?q") == "y-1"
    assert one(spark, F.array_join(urls.links_in("t"), " "), t="see (https://a.org/x). https://a.org/x, http://b.org") == "https://a.org/x http://b.org"


def test_text(spark):
    assert one(spark, text.collapse("t"), t=" a  b\n") == "a b"
    assert one(spark, text.collapse("t"), t=" \n") is None
    assert one(spark, text.match_text("t"), t="Müller & Söhne") == " muller sohne "
    assert one(spark, text.html_text("t"), t="&lt;b&gt;A&amp;amp; B&lt;/b&gt;") == "A&amp; B"
    assert one(spark, text.event_key("t"), t="The new AI of it") == "untitled"
    assert one(spark, text.event_key("t"), t="Acme launches seven big blue cranes near Berlin today") == "acme-seven-big-blue-cranes-near"
    assert one(spark, text.without_labels("t"), t="Exclusive: Report: Acme wins") == "Acme wins"
    assert one(spark, text.cut_words("t", 9, "..."), t="alpha beta gamma") == "alpha..."


@pytest.mark.parametrize("value, wanted", [
    ("Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01 10:00:00"), ("1 Jan 2024 10:00:00 +0200", "2024-01-01 08:00:00"), ("Tue, 2 Jan 2024 10:00 EST", "2024-01-02 15:00:00"), ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("soon", None),
])
def test_feed_time(spark, value, wanted):
    got = one(spark, F.date_format(dates.feed_time("t"), "yyyy-MM-dd HH:mm:ss"), t=value)
    assert got == wanted


def test_german_dates_and_weeks(spark):
    assert one(spark, dates.german_date("t"), t="Berlin, 3. März 2024") == dt.date(2024, 3, 3)
    assert one(spark, dates.german_date("t"), t="vom 03.04.2024") == dt.date(2024, 4, 3)
    for day in (dt.date(2023, 12, 20) + dt.timedelta(i) for i in range(25)):
        end = one(spark, dates.week_end(F.lit(day)))
        assert end.weekday() == 3 and 0 <= (end - day).days < 7
        year, week, _ = end.isocalendar()
        assert one(spark, dates.week_key(F.lit(day))) == f"{year}-W{week:02d}"


@pytest.mark.parametrize("story, wanted", [
    ("Acme raises $30 million after a $2m seed", ("$", "30", "m")), ("A $5bn market: Acme raised €12.50 mn", ("€", "12.5", "m")), ("Worth $2.0b and £700", ("£", "700", "")), ("No money", None),
])
def test_amount(spark, story, wanted):
    got = one(spark, extract.amount("t"), t=story)
    assert (tuple(got) if got else None) == wanted


def test_semantic_keys(spark):
    assert one(spark, extract.funding_entity("t"), t="Acme Robotics has just raised $3m") == "acme robotics"
    assert one(spark, extract.funding_entity("t"), t="The startup Beta Works got money") == "beta works"
    assert one(spark, F.array_join(extract.partnership_pair("t"), "+"), t="Zeta partners with Eta Group") == "eta group+zeta"
    assert one(spark, extract.partnership_pair("t"), t="Zeta partners with Eta. Zeta partners with Theta") is None
    assert one(spark, extract.quantity("t"), t="They add 1,200 Atlas robots") == "1200"
    assert one(spark, F.array_join(extract.investors("t"), "+"), t="led by North Fund and backed by South Capital") == "north fund+south capital"
    df = spark.createDataFrame([("Gamma and Delta deploy 1,200 humanoids", "2024-01-03"), ("Gamma and Delta deploy 900 humanoids", "2024-01-04"), ("Gamma and Delta deploy 1200 robots", "2024-01-09")], "t string, d string")
    k = df.select("t", extract.deployment_key("t", F.lit(None).cast("string"), F.to_timestamp("d")).alias("k"))
    first = k.filter("t like '%humanoids' and k.quantity = '1200'").select(F.col("k").alias("a"))
    got = {r["t"]: r["same"] for r in k.join(first).select("t", extract.same_deployment(F.col("a"), F.col("k")).alias("same")).collect()}
    assert list(got.values()) == [True, False, True]


def test_rules(spark):
    h = F.lower(F.col("t"))
    assert one(spark, rules.contains_any(h, ["api key"]), t="My API\n key") is True
    assert one(spark, rules.contains_any(h, ["api key"]), t="myapi keys") is False
    assert one(spark, rules.count_terms(h, ["a", "b", "a", "c"]), t="a b b") == 2
    assert one(spark, rules.gate([(F.col("t") == "x", "is_x")]), t="x").asDict() == {"status": "drop", "reason": "is_x"}


def test_tie_window_is_a_fold():
    row = lambda score, evidence, url: {"score": score, "evidence": evidence, "at": 0, "url": url}
    a, b, c = row(10, 0, "a"), row(6, 1, "b"), row(2, 2, "c")
    assert rank.tie_window_choice([a, b, c])["url"] == "c"
    assert rank.tie_window_choice([c, b, a])["url"] == "a"


def test_interval_match_meets_neighbouring_buckets(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1)), (1, 2, dt.datetime(2024, 1, 3, 23)), (1, 3, dt.datetime(2024, 1, 4)), (1, 4, dt.datetime(2024, 1, 4, 0, 0, 1))]
    df = spark.createDataFrame(rows, "k int, id int, ts timestamp")
    got = {(r["l"]["id"], r["r"]["id"]) for r in relational.interval_match(df, df, "k", "ts", 3).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if abs(a[2] - b[2]) <= dt.timedelta(3)}


def test_clusters_equal_one_fold_over_all(spark):
    import pandas as pd

    titles = ["alpha beta gamma delta", "alpha beta gamma", "beta gamma delta epsilon", "zeta eta theta", "eta theta zeta iota", "omega", "", "alpha beta gamma delta"]
    items = spark.createDataFrame([(i, t, f"u{i}", None) for i, t in enumerate(titles)], "id int, title string, url string, at timestamp")
    got = {r["id"]: r["cluster"] for r in resolve.cluster(items, "id", "title", "url", "at", "id").collect()}
    base = items.select("id", F.col("id").alias("order"), "url", "at", F.array_distinct(text.tokens("title")).alias("tokens"), text.event_key("title").alias("key")).toPandas()
    base["at"] = pd.NaT
    assert got == dict(resolve.fold_clusters(base).itertuples(index=False))


def test_clusters_and_pairs_need_no_rare_token(spark):
    import random

    import pandas as pd

    rng = random.Random(3)
    words = [f"word{i}" for i in range(14)]
    titles = [" ".join(rng.choices(words, k=rng.choice((0, 2, 3, 5, 8)))) for _ in range(330)]
    at = [None if rng.random() < 0.3 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(60)) for _ in titles]
    rows = [(i, (i * 7) % 331, t, f"u{rng.randrange(300)}", d) for i, (t, d) in enumerate(zip(titles, at))]
    items = spark.createDataFrame(rows, "id int, place int, title string, url string, at timestamp")
    got = {r["id"]: r["cluster"] for r in resolve.cluster(items, "id", "title", "url", "at", "place").collect()}
    sets = [set(t.split()) for t in titles]
    keys = ["-".join(t.split()[:6]) for t in titles]
    base = pd.DataFrame({"id": range(len(rows)), "order": [r[1] for r in rows], "url": [r[3] for r in rows], "at": pd.to_datetime(pd.Series(at)), "tokens": [sorted(x) for x in sets], "key": keys})
    assert got == dict(resolve.fold_clusters(base).itertuples(index=False))
    near = lambda a, b: at[a] is None or at[b] is None or abs(at[a] - at[b]) <= dt.timedelta(10)
    alike = lambda a, b: keys[a] == keys[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.75)
    pairs = {(r["a"], r["b"]) for r in resolve.similar_pairs(items, "id", "title", "at").collect()}
    assert pairs == {(a, b) for b in range(len(rows)) for a in range(b) if near(a, b) and alike(a, b)}


def test_event_clusters_of_frequent_tokens(spark, tmp_path):
    import itertools

    import pandas as pd

    from skeinwork.plans.rank_queries import event_clusters
    from skeinwork.plans.registry import Tables

    rows = [(i, " ".join(x)) for i, x in enumerate(itertools.permutations([f"word{i}" for i in range(6)], 4)) if i % 2]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = pd.DataFrame([{"id": i, "order": i, "url": t, "at": pd.NaT, "tokens": t.split(), "key": t.replace(" ", "-")} for i, t in rows])
    got = {r["id"]: r["cluster"] for r in event_clusters(Tables(spark, str(tmp_path))).collect()}
    assert got == dict(resolve.fold_clusters(base).itertuples(index=False))


def test_near_duplicates_of_frequent_tokens_and_late_text(spark, tmp_path):
    import itertools
    import random
    import re
    from difflib import SequenceMatcher

    from skeinwork.plans.history_queries import near_duplicate_stories
    from skeinwork.plans.registry import Tables

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    tails = [" ".join(rng.choices(words, k=120)) for _ in range(8)]
    heads = [" ".join(rng.choices(words, k=60)) for _ in range(8)]
    rows = [(i, rng.choice(["en", "de"]), f"common {' '.join(rng.choices(words, k=5))}\n{rng.choice(heads)} {rng.choice(tails)}") for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def same(x, y):
        a, b = (r[2].split("\n")[0][:80] for r in (x, y))
        s, t = set(a.split()), set(b.split())
        p, q = ({w for w in re.findall("[a-z0-9]+", r[2])} for r in (x, y))
        return SequenceMatcher(None, a, b).ratio() >= 0.78 or len(s & t) / min(len(s), len(t)) >= 0.8 or (len(p & q) >= 5 and len(p & q) / min(len(p), len(q)) >= 0.62)

    wanted = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] == y[1] and same(x, y)}
    assert wanted and {(r["a"], r["b"]) for r in near_duplicate_stories(Tables(spark, str(tmp_path))).collect()} == wanted


def test_long_chains_are_one_group(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000 - i, 999 - i) for i in range(300)]
    got = {r["node"]: r["group"] for r in resolve.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {i: 700 for i in range(700, 1001)}


def test_state(spark, tmp_path):
    table = state.Versions(spark, str(tmp_path / "t"))
    first = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "b", 5)], "k int, at int, v string, created int")
    table.merge(first, ["k"], "at", ["created"])
    table.merge(spark.createDataFrame([(1, 3, "c", 9), (1, 2, "x", 9), (3, 1, "d", 9)], first.schema), ["k"], "at", ["created"])
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 3, "c", 5), (2, 1, "b", 5), (3, 1, "d", 9)]
    assert list(table.manifest().values()) == [2, 3]


def test_feed_repair(spark):
    bad = "<rss><channel><item><title>A & B\x01</title><link>http://x.org/1</link></item><item><title>C<link>http://x.org/2</link></item></channel>"
    got = feeds.rss_items(spark.createDataFrame([("s", bad)], "source_id string, body string")).collect()
    assert [(r["title"], r["url"]) for r in got] == [("A & B", "http://x.org/1")]


def test_article_prefers_json_ld(spark):
    ld = '<script type="application/ld+json">{"@type": "NewsArticle", "articleBody": "The body. %s"}</script>' % ("More of it. " * 12) + '<p>Other text that is long enough to be a block of its own.</p>'
    html = "<nav><p>Navigation that would be long enough to be a block.</p></nav><p>Other text that is long enough to be a block of its own.</p>"
    rows = spark.createDataFrame([(1, ld), (2, html), (3, None)], "page_id long, html string")
    got = {r["page_id"]: (r["status"], r["article"]) for r in pages.article_text(rows).collect()}
    assert got == {1: ("json_ld", ("The body. " + "More of it. " * 12).strip()), 2: ("html", "Other text that is long enough to be a block of its own."), 3: ("empty", "")}


def test_json_ld_texts_are_scored():
    say = lambda **node: '<script type="application/ld+json">%s</script>' % json.dumps(node)
    long, longer = "a story " * 20, "another text " * 40
    best = pages._json_ld_text
    assert best(say(**{"@type": "NewsArticle", "articleBody": long}) + say(**{"@type": "Thing", "description": longer})) == long.strip()  # 160 + 1500 against 520
    assert best(say(**{"@type": "Thing", "description": longer}) + say(**{"@type": "Thing", "description": long})) == longer.strip()
    assert best(say(**{"@type": ["WebPage"], "description": longer})) is None and best(say(**{"@type": "WebPage", "articleBody": longer})) == longer.strip()
    assert best(say(**{"@type": "NewsArticle", "articleBody": long + "an award-winning journalist"})) is None and best(say(articleBody="short")) is None
    assert best(say(**{"@graph": [{"@type": "Person", "description": longer}, {"@type": "BlogPosting", "description": long}]})) == long.strip()
    assert best('<script type="application/ld+json">{bad</script>' + say(articleBody=long + "&amp;")) == long + "&" and best("") is None


def test_registry_rejects(spark):
    with pytest.raises(ValueError):
        registry.sources(spark, [{"id": "a"}])


def test_summaries():
    assert summary.summarise("Acme wins", "Acme won. It will build forty homes in Leeds this year.") == "Acme wins. It will build forty homes in Leeds this year."
    assert summary.summarise(None, None) is None
    assert summary.sanitised("It was cut off and") is None
    assert summary.trim_sentence(" ".join(["the"] * 40)) == "the."


def test_items(spark):
    from skeinwork.sources import items

    base = {"kind": "rss", "layer": "direct", "is_wrapper": False, "enabled": True, "parser": "p", "url": "https://a.org", "priority": 5}
    dim = registry.sources(spark, [{"id": "a", "name": "A", "is_direct_source": True, **base, "parser_hint": "x", "tags": ["t", "u"]}, {"id": "b", "name": "B", "is_direct_source": False, **base}])
    raw = spark.createDataFrame([("a", " https://A.org/x?utm_id=1#y ", " A  title ", "s\n s", "e1"), ("b", "https://b.org/1", "B", None, None), ("a", "nowhere", "C", None, None), ("a", "https://a.org/2", " ", None, None)], "source_id string, url string, title string, snippet string, external_id string").withColumn("published_ts", F.lit(None).cast("timestamp"))
    got = {r["source_id"]: r for r in items.normalized(raw, dim).collect()}
    assert set(got) == {"a", "b"} and got["a"]["canonical_url"] == "https://A.org/x" and got["a"]["domain"] == "a.org" and got["a"]["title"] == "A title" and got["a"]["text_preview"] == "s s"
    assert got["a"]["directness_rank"] == 100 and got["b"]["directness_rank"] == 10 and got["a"]["metadata"] == {"external_id": "e1", "parser": "p", "tags": "t,u", "parser_hint": "x"}
    over = spark.createDataFrame([('{"2024-W05": [{"id": "1", "title": "T", "url": "https://x.org"}, {"id": "2", "title": "U", "url": "x"}]}',), ("{",)], "value string")
    assert [(r["id"], r["score"]) for r in items.overrides(over, "2024-W05").collect()] == [("1", 100)]


@pytest.mark.parametrize("title, preview, wanted", [
    ("Acme launches Spot robot for sites", None, ("acme", "spot robot")), ("Acme unveils something", "It shows its new Atlas Pro platform today.", ("acme", "atlas pro platform")), ("Acme launches robots", None, None), ("Nobody here", "its Atlas platform", None),
])
def test_launch_key(spark, title, preview, wanted):
    got = one(spark, extract.launch_key("t", "p"), t=title, p=preview)
    assert (tuple(got) if got else None) == wanted


@pytest.mark.parametrize("limit", [1, 3, 5, 20])
def test_turns_end_with_a_round_of_repeats(spark, limit):
    listings = {"a": ["u1", "u2", "u1", "u9", "u7"], "b": ["u3", "u2", "u3", "u8"], "c": ["u4"], "d": ["u1", "u5", "u2"]}
    taken, turn = [], 0
    while len(taken) < limit:
        new = []
        for links in listings.values():
            if len(links) > turn and links[turn] not in taken + new:
                new.append(links[turn])
        if not new:
            break
        taken, turn = taken + new, turn + 1
    rows = [(name, i, u) for name, links in listings.items() for i, u in enumerate(links)]
    df = spark.createDataFrame(rows, "source string, at int, url string")
    got = relational.round_robin(df, "source", "source", "at", "url", limit).orderBy("place")
    assert [r["url"] for r in got.collect()] == taken[:limit]
    assert "u8" not in taken and relational.round_robin(df.limit(0), "source", "source", "at", "url", limit).isEmpty()


def test_follow_ups_are_no_duplicates(spark):
    story = (True, "https://a.org/2", "https://a.org/1", "Second tower", "First tower", 7)
    changed = lambda i, v: story[:i] + (v,) + story[i + 1 :]
    rows = [story, changed(0, False), changed(2, " "), changed(2, None), changed(2, story[1]), changed(4, " second TOWER "), changed(5, 6), changed(5, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s boolean, u string, m string, t string, n string, d int")
    got = df.orderBy("i").select(reviews.follow_up(*(F.col(c) for c in "sumtnd")).alias("x")).collect()
    assert [r["x"] for r in got] == [True] + [False] * 7
