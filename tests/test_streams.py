"""Streams in several triggers, with replays, state that expires, late rows and update ingest."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest

from skeinwork.operators.keyed_table import KeyedTable
from skeinwork.streaming import ingest, streams

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1)


def events(n, seed):
    rng = random.Random(seed)
    return [(i, START + timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.randrange(7), rng.choice("ab"), float(rng.randrange(100))) for i in range(n)]


def in_turns(spark, path, rows, stream, sink, mode, turns=2):
    """Rows land in turns, the stream runs after each; at the end the last batch runs again."""
    folder, checkpoint = f"{path}/in", f"{path}/checkpoint"
    df = spark.createDataFrame(rows, EVENT).coalesce(1)
    run = lambda: streams.drained(stream(streams.event_stream(spark, folder, df)), checkpoint, sink, mode)
    streams.landed(df, folder, "event_id", turns, run)
    streams.forgotten(spark, checkpoint)
    return run()


@pytest.mark.parametrize("which", ["latest", "toggle"])
def test_keyed_state_equals_its_batch_form(spark, tmp_path, which):
    rows = events(200, 3)
    table = KeyedTable(spark, f"{tmp_path}/t", ["user_id"] if which == "latest" else ["user_id", "event_type"])
    with streams.on_disk_state(spark):
        told = in_turns(spark, tmp_path, rows, streams.latest_state if which == "latest" else streams.toggle_states, streams.merged_into(table, "s"), "update")
    got = sorted(tuple(r) for r in table.read().collect())
    if which == "latest":
        best = {}
        for i, ts, user, kind, _ in rows:
            best[user] = max(best.get(user, (START, -1, "")), (ts, i, kind))
        assert got == sorted((u, ts, kind) for u, (ts, _, kind) in best.items())
    else:
        n = {}
        for _, _, user, kind, _ in rows:
            n[user, kind] = n.get((user, kind), 0) + 1
        assert got == sorted((*k, c % 2 == 1) for k, c in n.items())
    assert table.state()["number"] == 2  # a replay commits nothing
    (state,) = told[-1]["stateOperators"]
    assert state["numRowsTotal"] == len(got)  # one value a key, however many events


def test_state_expires(spark, tmp_path):
    rows = events(40, 4)
    table = KeyedTable(spark, f"{tmp_path}/t", ["user_id", "event_type"])
    df = spark.createDataFrame([(i, ts, 1, "a", v) for i, ts, _, _, v in rows], EVENT)
    with streams.on_disk_state(spark):
        run = lambda: streams.drained(streams.toggle_states(streams.event_stream(spark, f"{tmp_path}/in", df), ttl_ms=1), f"{tmp_path}/c", streams.merged_into(table, "s"), once=True)
        streams.landed(df.filter("event_id < 3"), f"{tmp_path}/in", "event_id", 3, run)
    assert [r["active"] for r in table.read().collect()] == [True]  # each turn's one event found a key that is off


def test_late_rows(spark, tmp_path):
    rows = events(300, 5)
    sink = streams.LateSplit(spark, f"{tmp_path}/t", "1 day", "3 days")
    in_turns(spark, tmp_path, rows, lambda df: df, sink, "append", 3)
    wanted, sums, high = {}, {}, None
    for turn in range(3):
        own = [r for r in rows if r[0] % 3 == turn]
        for _, ts, _, kind, value in own:
            status = "on time" if high is None or ts >= high - timedelta(days=1) else "recovered" if ts >= high - timedelta(days=3) else "dropped"
            wanted[turn, status] = wanted.get((turn, status), 0) + 1
            if status != "dropped":
                key = (ts.replace(hour=0, minute=0), kind)
                n, total = sums.get(key, (0, 0.0))
                sums[key] = (n + 1, total + value)
        high = max([high or START, *(r[1] for r in own)])
    assert {(r["batch"], r["status"]): r["n"] for r in sink.statuses().collect()} == wanted and {s for _, s in wanted} == {"on time", "recovered", "dropped"}
    assert {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in sink.windows().collect()} == sums


def test_windows_leave_late_rows_out(spark, tmp_path):
    got = []
    rows = [(0, START, 1, "a", 1.0), (1, START + timedelta(days=9), 1, "a", 2.0), (2, START, 1, "a", 4.0), (3, START + timedelta(days=8), 1, "a", 8.0)]
    df = spark.createDataFrame(rows, EVENT)
    run = lambda: streams.drained(streams.windowed(streams.event_stream(spark, f"{tmp_path}/in", df)), f"{tmp_path}/c", lambda d, b: got.extend(map(tuple, d.collect())))
    streams.landed(df, f"{tmp_path}/in", "event_id div 2", 2, run)
    last = {g[0].day: g[3] for g in got}
    assert last[9] == 8.0 and last[10] == 2.0 and last.get(1, 1.0) == 1.0


def update(i, **what):
    return json.dumps({"update_id": i, **what})


def message(key, text, bot=False, **more):
    return {"message_id": key, "date": 1704103200 + key, "chat": {"id": -5}, "from": {"id": 7, "is_bot": bot}, "text": text, **more}


def reaction(key, old, new, user=7):
    emoji = lambda xs: [{"type": "emoji", "emoji": x} for x in xs]
    return {"message_id": key, "date": 1704103200, "chat": {"id": -5}, "user": {"id": user}, "old_reaction": emoji(old), "new_reaction": emoji(new)}


TURNS = [
    [update(1, message=message(1, "see https://a.org/x")), update(2, message=message(2, "text only")), update(3, message_reaction=reaction(1, "", "AB")), "not json", update(4, callback_query={"id": "q"})],
    [update(5, message=message(1, "now https://b.org/y https://c.org")), update(6, channel_post=message(3, "from a bot", bot=True)), update(7, message_reaction=reaction(1, "AB", "B")), update(8, message_reaction=reaction(1, "", "Z"))],
    [update(9, message=message(4, "")), update(10)],
]


def ingested(spark, path, **more):
    sink = ingest.Ingest(spark, f"{path}/t", ("like", "emoji:B"), {"A": "like"}, **more)
    for i, lines in enumerate(TURNS):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{path}/in")
        streams.drained(ingest.update_lines(spark, f"{path}/in"), f"{path}/c", sink, "append")
    streams.forgotten(spark, f"{path}/c")
    streams.drained(ingest.update_lines(spark, f"{path}/in"), f"{path}/c", sink, "append")
    return sink


def test_ingest(spark, tmp_path):
    sink = ingested(spark, tmp_path)
    assert {r["message_id"]: (r["text"], r["urls"], r["only_url"]) for r in sink.messages.read().collect()} == {
        "1": ("now https://b.org/y https://c.org", ["https://b.org/y", "https://c.org"], None), "3": ("from a bot", [], None)
    }
    assert {r["reaction_key"]: r["is_active"] for r in sink.picks.read().collect()} == {"like": False, "emoji:B": True}
    assert [tuple(r) for r in sink.counts.read().orderBy("batch").collect()] == [(0, 4, 2, 1, 2), (1, 4, 3, 2, 2), (2, 2, 0, 0, 0)]
    assert [tuple(r) for r in sink.cursors.read().collect()] == [("chat", 11)] and sink.messages.state()["number"] == 3


@pytest.mark.parametrize("switches", [ingest.Switches(messages=False), ingest.Switches(enabled=False)])
def test_ingest_switches(spark, tmp_path, switches):
    sink = ingested(spark, tmp_path, switches=switches)
    found = [t.read().count() if t.read() is not None else 0 for t in (sink.messages, sink.picks)]
    assert found == [2 * (switches.messages and switches.enabled), 2 * (switches.reactions and switches.enabled)]
    assert (sink.cursors.read() is None) == (not switches.enabled)


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    got = []
    df = spark.createDataFrame(events(150, 6), EVENT).coalesce(1)
    whole = {tuple(r) for r in streams.sessions(df, "5 hours").collect()}
    run = lambda: streams.drained(streams.sessions(streams.event_stream(spark, f"{tmp_path}/in", df), "5 hours", "30 days"), f"{tmp_path}/c", lambda d, b: got.extend(map(tuple, d.collect())), "append")
    streams.landed(df, f"{tmp_path}/in", "event_id", 2, run)
    assert not got  # none is closed before the watermark
    late = spark.createDataFrame([(999, START + timedelta(days=60), 1, "a", 0.0)], EVENT)
    streams.landed(late, f"{tmp_path}/in", "0", 1, run)
    assert set(got) == whole and len(got) == len(whole)
