"""The keyed table: merges, replaced groups, two writers, replays, compaction, old versions."""

from __future__ import annotations

import random
import threading

import pytest

from skeinwork.operators import keyed_table
from skeinwork.operators.keyed_table import KeyedTable

KIND = "k long, g string, at long, v string, made long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merges_and_deletes_in_any_order(spark, tmp_path):
    """Against a dictionary; a null is a key, columns that are kept stay until a key is gone."""
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "g"], keep=["made"])
    assert table.read() is None and table.delete(spark.createDataFrame([(1, "a")], "k long, g string")) == 0
    rng, wanted = random.Random(2), {}
    for step in range(8):
        if step == 5:
            keys = list(wanted)[::3]
            table.delete(spark.createDataFrame(keys, "k long, g string"))
            for k in keys:
                del wanted[k]
            continue
        batch = [(rng.choice([None, *range(6)]), rng.choice(["a", "b", None]), rng.randrange(3), f"{step}-{i}", step) for i in range(12)]
        table.merge(spark.createDataFrame(batch, KIND).repartition(2), at="at")
        best = {}
        for k, g, at, v, made in batch:
            if (k, g) not in best or (at, v) > best[k, g][:2]:
                best[k, g] = (at, v, made)
        for key, (at, v, made) in best.items():
            wanted[key] = (at, v, wanted[key][2] if key in wanted else made)
        if step == 3:
            assert table.compact() is not None and table.compact() is None
        assert rows(table.read()) == sorted(((*k, *v) for k, v in wanted.items()), key=str)
    assert table.read().columns == ["k", "g", "at", "v", "made"] and len(rows(table.read(1))) < len(wanted)


def test_groups_are_replaced_whole(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["m"], several=True)
    kind = "m long, url string"
    table.merge(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], kind))
    table.merge(spark.createDataFrame([(1, "d"), (3, "e"), (3, "e")], kind))
    table.delete(spark.createDataFrame([(2,)], "m long"))
    assert rows(table.read()) == [(1, "d"), (3, "e"), (3, "e")]
    table.compact()
    assert rows(table.read()) == [(1, "d"), (3, "e"), (3, "e")] and rows(table.read(1)) == [(1, "a"), (1, "b"), (2, "c")]


def test_a_merge_writes_its_batch_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.merge(spark.range(200_000).selectExpr("id as k", "uuid() as v"))
    (big,) = table.written().values()
    table.merge(spark.createDataFrame([(5, "new")], "k long, v string"))
    assert min(table.written().values()) < big / 500 and table.read().filter("k = 5").collect() == [(5, "new")] and table.read().count() == 200_000


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    first, second = (spark.createDataFrame([(1, x)], "k long, v string") for x in "ab")
    assert table.merge(first, writer="s", batch=0) == 1 and table.merge(second, writer="s", batch=1) == 2
    assert table.merge(first, writer="s", batch=0) == 2 and table.merge(first, writer="s", batch=1) == 2 and len(table.written()) == 2
    assert rows(table.read()) == [(1, "b")] and table.merge(first, writer="other", batch=0) == 3


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    """Each has read the same state before any commits."""
    monkeypatch.setattr(keyed_table, "WAITING", 3)
    path, meet, failed = str(tmp_path / "t"), threading.Barrier(4), []

    def write(i):
        try:
            table = KeyedTable(spark, path, ["k"])
            seen = table.state
            first = [True]

            def state(number=None):
                found = seen(number)
                if first[0]:
                    first[0] = False
                    meet.wait(60)
                return found

            table.state = state
            for j in range(3):
                table.merge(spark.createDataFrame([(10 * i + j, f"{i}"), (99, f"{i}-{j}")], "k long, v string"), writer=str(i), batch=j)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    table = KeyedTable(spark, path, ["k"])
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert sorted(got) == sorted([99, *(10 * i + j for i in range(4) for j in range(3))]) and got[99].endswith("-2") and len(table.state()["parts"]) < 12
    assert table.state()["batches"] == {str(i): 2 for i in range(4)}


def test_a_commit_has_one_writer(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.merge(spark.createDataFrame([(1, "a")], "k long, v string"))
    before = table.state()
    assert not table._commit(1, before) and table._commit(2, before) and not table._commit(2, before) and table._names("drafts") == []


def test_old_versions_are_removed(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    for i in range(4):
        table.merge(spark.createDataFrame([(i % 2, str(i))], "k long, v string"))
    table.compact()
    assert len(table.written()) == 5 and len(table.vacuum(kept=1)) == 4 and len(table.written()) == 1 and table.commits() == [5]
    assert rows(table.read()) == [(0, "2"), (1, "3")]
    with pytest.raises(Exception, match="0000000001"):
        table.read(1)
