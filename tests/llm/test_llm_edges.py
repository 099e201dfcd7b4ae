"""Skew, long texts and boundaries of the training-data operators."""

from __future__ import annotations

import collections
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import best_fit_pack, exact_dedup, line_crf, substring_fm, text_hash, toxicity

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _cut(rows):
    """doc_id, words left of each row by definition."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("words", [40, 600])
def test_heavy_marks_are_split(spark, monkeypatch, words):
    """A line that every document has, followed by texts that differ, repeat or repeat in part."""
    monkeypatch.setattr(substring_fm, "SHARD_WORDS", words)
    rng = random.Random(11)
    line, tails = prose(rng, 30), [prose(rng, 70) for _ in range(6)]
    texts = [f"{prose(rng, 20)} {line} {rng.choice(tails) if i % 2 else prose(rng, 60)} {prose(rng, 15)}" for i in range(60)] + [line, None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = _cut(rows)
    assert any(len((t or "").split()) != len(kept.split()) for (i, kept) in wanted for j, t in rows if i == j)
    got = substring_fm.remove_repeats(docs, with_text=True)
    assert collections.Counter((r["doc_id"], r["kept_text"]) for r in got.collect()) == wanted


def test_bits_rank_and_select():
    rng = np.random.default_rng(3)
    for n, share in ((1, 1.0), (64, 0.5), (5000, 0.01), (5000, 0.9)):
        bit = rng.random(n) < share
        bit[-1] = True
        bits, ones = substring_fm.Bits(bit), np.flatnonzero(bit)
        assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()
        assert bits.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(bit)]).tolist()


def test_lines_belong_to_their_text():
    texts = ["a\n", "b\nc", "", "d\n\n", None, "\n", "e"]
    data, offsets = text_hash.texts(pa.array(texts))
    doc, starts, ends = line_crf.lines(data, offsets)
    got = [(int(d), data[a:z].tobytes().decode()) for d, a, z in zip(doc, starts, ends)]
    assert got == [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(5)
    return line_crf.LineField(rng.normal(size=3 * line_crf.OWN + 3), rng.normal(size=(2, 2)), 3.0, 0.2)


def test_quality_is_of_the_text_alone(spark, field):
    rng = random.Random(2)
    texts = ["one line\n", "", None, "\n", "x\n\n\n", "A B C\nlower case words, some of them.\n", prose(rng, 400).replace("w1", "\n"), "y"] * 3
    alone = [float(field.score(*text_hash.texts(pa.array([t], pa.string())))[0]) for t in texts]
    for seed in range(4):
        order = random.Random(seed).sample(range(len(texts)), len(texts))
        assert field.score(*text_hash.texts(pa.array([texts[i] for i in order], pa.string()))).tolist() == [alone[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        assert {r["doc_id"]: r["score"] for r in line_crf.score_quality(docs.repartition(parts), field).collect()} == dict(enumerate(alone))
    assert line_crf.score_quality(spark.createDataFrame([(1, "one line\n")], "doc_id long, text string"), field).count() == 1


def test_blocks_change_no_score(field, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(300)).replace("w2", "\n") for _ in range(30)]
    data, offsets = text_hash.texts(pa.array(texts))
    whole, features = field.score(data, offsets), line_crf.line_features(data, offsets)
    assert np.allclose(field.line_scores(data, *line_crf.lines(data, offsets)), features[2] @ field.weights, atol=1e-4)
    monkeypatch.setattr(line_crf, "BLOCK_LINES", 3)
    monkeypatch.setattr(line_crf, "BLOCK_BYTES", 50)
    assert field.score(data, offsets).tolist() == whole.tolist()


def test_long_chains_equal_short_ones():
    rng = np.random.default_rng(6)
    for n in (2, 3, 4, 5, 10, 101, 3000):
        own, steps = rng.normal(size=(n, 2)) * 3, rng.normal(size=(2, 2))
        wanted = line_crf._chains(own, np.array([0]), np.array([n]), steps)
        got = line_crf._long_chain(own, steps)
        assert np.allclose(got[0], wanted[0]) and np.allclose(got[1], wanted[1])


def test_a_text_of_many_lines(field):
    import time

    began = time.time()
    score = field.score(*text_hash.texts(pa.array(["\n" * 1_000_000])))
    assert 0 <= score[0] <= 1 and time.time() - began < 30


def _large(sf_dir):
    where = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    return where if os.path.isdir(where) else sf_dir


def _auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(1, good.sum() * (~good).sum())


def test_held_out_quality(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{_large(sf_dir)}/{t}.parquet") for t in ("documents", "labels"))
    rows = line_crf.score_quality(d, line_crf.fit_quality(d, labels)).filter("held_out").join(labels, "doc_id").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert len(rows) > 20 and _auc(score, label) > 0.95 and np.mean((score >= 0.7) == (label == 1)) > 0.9


def test_held_out_toxicity(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{_large(sf_dir)}/{t}.parquet") for t in ("documents", "labels"))
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.fit_toxicity(d, labels.filter(~odd))
    rows = toxicity.score_toxicity(d, model).join(labels.filter(odd), "doc_id").collect()
    score, label = np.array([r["severity"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert label.sum() > 3 and _auc(score, label) > 0.95 and np.mean([r["toxic"] for r in rows]) < 0.5


def test_toxic_rows_go_and_others_stay_whole(spark):
    model = toxicity.train(["you idiot", "a moron here", "idiot and moron and idiot", "such an idiot"] * 6 + ["plain words", "more words here", None, ""] * 6, np.array([1] * 24 + [0] * 24))
    rows = [(1, "kind words", {"a": 1}, "x"), (2, "an idiot and a moron", None, "y"), (3, None, {}, None), (1, "kind words", {"a": 1}, "x"), (None, "", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, c1 string")
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] != 2)
    assert toxicity.without_toxic(docs.drop("text"), model).count() == 5


def test_a_hot_digest_fills_no_task(spark):
    rng = random.Random(8)
    rows = [(i, "the one text" if i % 2 else prose(rng, 5)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        for k, v in zip(before, ("-1", "false", "16", "4096")):
            spark.conf.set(k, v)
        groups = exact_dedup.duplicate_groups(docs)
        sizes = [r["count"] for r in groups.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000
        assert exact_dedup.deduplicate(docs).count() == groups.filter("kept").count() == len({t for _, t in rows})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_deduplicate_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = [prose(rng, rng.randrange(1, 6)) for _ in range(25)]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", *base, *(f" {b}\n" for b in base)]), {"n": i}) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(5)
    best = {}
    for i, t, _ in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        best[norm] = min(best.get(norm, (1, True, 0)), (-len(t or ""), i is None, -1 if i is None else i))
    for hot in (4096, 20):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        kept = exact_dedup.deduplicate(docs)
        assert kept.columns == docs.columns
        got = [(re.sub("[\x20\x09-\x0d]", "", r["text"] or ""), (-len(r["text"] or ""), r["doc_id"] is None, -1 if r["doc_id"] is None else r["doc_id"])) for r in kept.collect()]
        assert len(got) == len(best) and dict(got) == best


def test_tokenizer_keeps_bounded_runs():
    P = pytest.importorskip("public_tokenizers")
    t = best_fit_pack.WordTokenizer(P.path("word_bpe_49k.json"))
    for i in range(0, 400_000, 1000):
        t.ids(" ".join(f"r{n}" for n in range(i, i + 1000)))
    assert len(t.runs) * best_fit_pack.ENTRY <= best_fit_pack.KEPT_BYTES + 1000 * 300
