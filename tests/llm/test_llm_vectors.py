"""Product codes, importance resampling and cap filters against brute force; their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import cap_filters, code_compression, feature_resampling, line_crf, ngram_join
from skeinwork.llm.cap_filters import Filters, near_duplicates
from skeinwork.llm.code_compression import Codebooks, compress
from skeinwork.llm.feature_resampling import resample


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3)


def by_hand(rows):
    """op11's rows by definition."""
    kept = sorted((i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    n = len(kept[0][1]) // 8
    cut = [[v[p * n : (p + 1) * n] for p in range(8)] for _, v, _ in kept]
    books = [[list(parts[p]) for parts in cut[:16]] for p in range(8)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            held = collections.defaultdict(list)
            for parts in cut:
                held[near(p, parts[p])[1]].append(parts[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = [[near(p, parts[p]) for p in range(8)] for parts in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    total = collections.Counter()
    for (_, _, y), e in zip(kept, errors):
        total[y] += e
    return sorted((i, "".join(f"{e:02x}" for _, e in c), err, total[y], digest) for (i, _, y), c, err in zip(kept, coded, errors))


@pytest.mark.parametrize("dimensions", [8, 24])
def test_codes_are_those_of_the_definition(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    rows = [(int(i), rng.normal(size=dimensions).tolist(), [None, 0, 1, 1, 1][i % 5]) for i in rng.permutation(150)]
    rows += [(200 + i, [0.25] * dimensions, 1) for i in range(30)]  # ties and copies
    rows += [(300, None, 1), (301, [None] * dimensions, 1), (302, [math.nan] * dimensions, 1), (303, [math.inf] + [0.0] * (dimensions - 1), 0), (304, [], 0)]
    got = compress(vectors(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == by_hand([r for r in rows if r[1] != []])


def test_partial_distances_decide_as_whole_ones():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, c = rng.integers(-3, 4, (300, 6)), rng.integers(-3, 4, (8, 16, 6))  # many ties
        d = ((x[:, None] - c[2][None]) ** 2).sum(axis=2)
        near, distance = Codebooks(c).nearest(x, 2)
        assert (near == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_codes_edges(spark):
    few = compress(vectors(spark, [(1, [0.5] * 8, None), (1, [0.5] * 8, None), (None, [0.25] * 8, 3)])).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in few) == [(0, "0202020202020202", 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0)]
    assert compress(vectors(spark, [])).count() == 0 and compress(vectors(spark, [(1, None, 1)])).count() == 0
    odd = compress(vectors(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 9, 1)])).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in odd} == {1: ("00" * 8, 0, 0), 2: (None, None, 0)}
    assert compress(vectors(spark, [(i, [0.1 * i] * 5, 1) for i in range(20)]).withColumn("code", F.lit("x")).withColumn("of", F.lit(1))).count() == 20
    assert compress(vectors(spark, [(1, [1.0] * 8, 1)], "array<double>").drop("label")).first()["label_error"] == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def drawn_by_hand(docs, target):
    """op12's rows by definition: (n_words, n_features, weight, score, rank) by doc_id."""
    lower = {i: i + 32 for i in range(65, 91)}

    def features(text):
        w = WORD.findall((text or "").translate(lower))
        return len(w), collections.Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = collections.Counter(), collections.Counter()
    own = {i: features(x) for i, x in docs}
    for _, c in own.values():
        for f, n in c.items():
            s[bucket(f)] += n
    for x in target:
        for f, n in features(x)[1].items():
            t[bucket(f)] += n
    a, b = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b)))
    out = {}
    for i, (n, c) in own.items():
        w = sum(k * gain(bucket(f)) for f, k in c.items())
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, sum(c.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    ranked = sorted((i for i in out if out[i][0] >= 20), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(ranked[: 5 * len(ranked) // 100], 1):
        out[i][4] = k
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("segment", [(1 << 21) - 3, 7])
def test_draw_is_that_of_the_definition(spark, monkeypatch, segment):
    monkeypatch.setattr(feature_resampling, "SEGMENT", segment)
    rng = random.Random(segment)
    words = ["Alpha", "beta", "ÄÖ", "naïve", "x1", "9", "東京", "é", "LONG" * 40, *(f"w{i}" for i in range(40))]
    docs = [(i, rng.choice([" ", ", ", "\n", "\x00"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 200])))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, " ".join(["same"] * 3000)), (1004, docs[7][1])]
    target = [" ".join(rng.choice(words[:12]) for _ in range(30)) for _ in range(10)] + [None, ""]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()} == drawn_by_hand(docs, target)


def test_crc_of_features_is_that_of_their_strings():
    text = "a bb ccc a bb " + "x" * 5000 + " ccc ünï 7"
    for _, _, _, found in feature_resampling.segments(pa.array([text, None, "zz"]), 1 << 20):
        strings = [x.as_py() for x in found.strings(found.keys)]
        assert [zlib.crc32(x) for x in strings] == found.crc32(found.keys).tolist() and b"a bb ccc" in strings


def test_draw_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, text, 1), *((10 + i, text, 1) for i in range(40))], "doc_id long, text string, score long")
    rows = resample(docs, none).collect()
    assert len(rows) == 43 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]  # of 42
    assert [(r["score"], r["rank"]) for r in rows if r["doc_id"] is None] == [(None, None)]
    assert resample(docs.limit(0), none).count() == 0


def linked_by_hand(rows, least=0.9):
    """op13's rows by definition."""
    good = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[k] @ good[j] / math.sqrt(good[k] @ good[k]) / math.sqrt(good[j] @ good[j]) >= least} for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, front = {k}, [k]
        while front:
            front = [j for f in front for j in near.get(f, ()) if j not in seen and not seen.add(j)]
        least_id = None if i is None else min(rows[j][0] for j in seen)
        out.append((i, len(near.get(k, ())), least_id, i is not None and i == least_id))
    return collections.Counter(out)


def found(spark, rows, kind="array<float>", **more):
    got = near_duplicates(vectors(spark, [(i, v, 1) for i, v in rows], kind), **more).collect()
    return collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)


@pytest.mark.parametrize("part", [1024, 8])
def test_near_vectors_are_linked(spark, monkeypatch, part):
    """Groups of copies and near copies, some larger than a part."""
    monkeypatch.setattr(cap_filters, "PART", part)
    rng = np.random.default_rng(part)
    rows = []
    for size, spread in ((1, 0), (2, 0.02), (40, 0.03), (30, 0.0), (5, 0.04)) * 2:
        centre = rng.normal(size=48)
        centre /= np.linalg.norm(centre)
        rows += [(centre + spread * rng.normal(size=48)).tolist() for _ in range(size)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    wanted = linked_by_hand(rows)
    assert sum(n * k for (_, n, _, _), k in wanted.items()) > 1000
    assert found(spark, rows) == wanted


@pytest.mark.parametrize("cosine", [0.9001, 0.92, 0.97])
def test_recall_of_pairs_near_the_bound(spark, cosine):
    rng = np.random.default_rng(int(cosine * 1e4))
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    got = near_duplicates(vectors(spark, [(i, v, 1) for i, v in enumerate(np.concatenate([a, b]).tolist())], "array<double>")).agg(F.sum("n_links")).first()[0]
    assert 0.97 * 3000 <= got <= 3000


def test_filters_decode_alike_anywhere():
    rng = np.random.default_rng(1)
    for d, n in ((1, 10), (2, 100), (7, 1000), (64, 10**6), (64, 10**10)):
        filters = Filters.build(d, n)
        unit = rng.normal(size=(40, d))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        row, number = filters.decode(unit)
        for i in (0, 17, 39):
            alone = filters.decode(unit[i : i + 1])[1]
            assert (alone == number[row == i]).all() and len(alone) >= (1 if d == 1 else cap_filters.FEWEST)
        if d == 64 and n == 10**6:  # every filter above the bound, and no other
            x = np.rint(np.rint(unit[:1] * (1 << 15)) @ filters.rotation.astype(float) / (1 << 15))
            whole, a = np.zeros(1), 0
            for c in filters.blocks[:2]:
                whole = (whole[:, None] + (x[0, a : a + len(c)] @ c.astype(float))[None, :]).ravel()
                a += len(c)
            if len(filters.blocks) == 2 and (whole >= filters.least).sum() >= cap_filters.FEWEST:
                assert np.flatnonzero(whole >= filters.least).tolist() == filters.decode(unit[:1])[1].tolist()


def test_near_vector_edges(spark):
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [math.nan, 1.0, 0.0]), (8, [math.inf, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]),
        (9, [1.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (11, [1e-30, 0.0, 0.0]), (12, [3.0]), (13, [-4.0]), (14, [0.5]),
    ]
    assert found(spark, rows) == linked_by_hand(rows)
    assert found(spark, []) == collections.Counter()
    extra = vectors(spark, [(1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1)]).withColumns({"c": F.lit(1), "v": F.lit("x"), "copies": F.lit(2), "label": F.lit(3)})
    assert [tuple(r) for r in near_duplicates(extra).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]


def test_near_copies_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 7, "a", "b"), (2, text + " more", 8, "c", "d"), (3, "else", 9, "e", "f"), (None, text, 1, "g", "h")], "doc_id long, text string, _gone_id int, _own_sig string, sig string")
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["_gone_id"]) for r in kept.collect()) == [(0, 1), (1, 7), (3, 9)]
    partly = docs.withColumn("doc_id", F.when(F.col("_gone_id") == 7, 1).otherwise(5))  # of the rows of id 5, one goes
    assert sorted(r["_gone_id"] for r in ngram_join.without_near_copies(partly.filter("_gone_id > 1")).collect()) == [7, 9]


def test_quality_labels_of_any_type(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = (line_crf.fit_quality(docs, x) for x in (labels, labels.withColumn("quality", F.col("quality").cast("string"))))
    assert np.array_equal(a.weights, b.weights)


def test_taken_words_come_near_their_targets(spark):
    """Fifty documents a source, of very uneven sizes."""
    from skeinwork.llm.source_mix import mix_sources

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * int(rng.lognormvariate(5, 1)), f"s{i % 8}") for i in range(400)], "doc_id long, text string, source string").repartition(3)
    rows = mix_sources(docs).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken[s] - t) < 0.03 * t for s, t in target.items())
    assert sorted(map(tuple, mix_sources(docs.repartition(5)).collect())) == sorted(map(tuple, rows))
