"""Toxicity as expected severity from a cumulative-link ordinal regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skeinwork.llm import text_hash as th
from skeinwork.llm.common import core, pick, release, tidy

#: Labelled rows a model is fitted on, half of them toxic where there are as many, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6000, 1 << 26
#: Features are words and their first bytes; the model keeps this many of the most telling.
FEATURES, PREFIXES, LEAST_DOCS = 1000, (4, 5, 6), 4
#: Probability of a grade above 0 from which a document is toxic.
TOXIC = 0.5


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning of a chunk of texts."""
    s, e, h, more = th.words(data, offsets[:-1], th.letters_table(), PREFIXES)
    row = np.searchsorted(offsets, s, side="right") - 1
    keep = [np.ones(len(s), bool), *[e - s > k for k in PREFIXES]]
    return np.concatenate([row[k] for k in keep]), np.concatenate([x[k] for x, k in zip([h, *more], keep)])


class OrdinalModel:
    """P(grade <= k) = logistic(threshold_k - weights . features): the thresholds are ordered
    and share the weights, so one direction of the text orders all grades."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def latent(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, h = _features(data, offsets)
        n = len(offsets) - 1
        if not len(self.vocabulary):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h
        pairs = np.unique(row[hit] * len(self.vocabulary) + at[hit])
        return np.bincount(pairs // len(self.vocabulary), self.weights[pairs % len(self.vocabulary)], n)

    def grades(self, latent: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))
        edges = np.hstack([np.zeros((len(latent), 1)), below, np.ones((len(latent), 1))])
        return np.diff(edges, axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood.

    The thresholds are a first one and the logarithms of the gaps, so they stay in order.
    """
    n, k = len(grade), int(grade.max(initial=0)) + 1
    k = max(k, 2)
    p = np.zeros(width + k - 1)
    p[width] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, first, gaps = p[:width], p[width], np.exp(np.clip(p[width + 1 :], -6, 6))
        theta = np.concatenate([[first], first + np.cumsum(gaps)])
        z = np.bincount(rows, w[cols], n)
        cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -40, 40)))
        edge = np.hstack([np.zeros((n, 1)), cum, np.ones((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), cum * (1 - cum), np.zeros((n, 1))])
        i = np.arange(n)
        prob = np.maximum(edge[i, grade + 1] - edge[i, grade], 1e-12)
        up, down = slope[i, grade + 1] / prob, slope[i, grade] / prob
        d_theta = np.zeros(k + 1)
        np.add.at(d_theta, grade + 1, -up)
        np.add.at(d_theta, grade, down)
        d_theta = d_theta[1:k]
        d_z = up - down
        g = np.zeros_like(p)
        g[:width] = np.bincount(cols, d_z[rows], width) / n + ridge * w
        g[width] = d_theta.sum() / n
        tail = np.cumsum(d_theta[::-1])[::-1][1:]
        g[width + 1 :] = tail * gaps / n
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    first, gaps = p[width], np.exp(np.clip(p[width + 1 :], -6, 6))
    return p[:width], np.concatenate([[first], first + np.cumsum(gaps)])


def _distinct_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of uses of each feature of each text that LEAST_DOCS texts may have.

    Chunk by chunk, with a table of counts by hash bucket: a feature in a bucket of fewer pairs
    than that is too rare to be kept, which is true of nearly all.
    """
    buckets = 1 << 22
    mask, parts = np.uint64(buckets - 1), []
    counts = np.zeros(buckets, np.int32)
    for first, _, data, offsets in th.chunks(pa.array(texts, pa.string()), 1 << 20):
        row, h = _features(data, offsets)
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(h)))
        parts.append(((row[start] + first).astype(np.int32), h[start], times.astype(np.int32)))
        counts += np.bincount((h[start] & mask).astype(np.int64), minlength=buckets).astype(np.int32)
    for i, part in enumerate(parts):
        often = counts[(part[1] & mask).astype(np.int64)] >= LEAST_DOCS
        parts[i] = tuple(x[often] for x in part)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*parts))


def train(texts: list[str | None], toxic: np.ndarray) -> OrdinalModel:
    """A model of the labelled texts.

    labels know toxic or not; the grades above 0 come from how many of the words that mark
    toxic texts a toxic text uses: one, two to four, five or more. Without labelled texts
    nothing is toxic.
    """
    if not texts:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0]))
    row, h, times = _distinct_features(texts)
    vocabulary, col = np.unique(h, return_inverse=True)
    n, width = len(texts), max(1, len(vocabulary))
    in_toxic = np.bincount(col, toxic[row], width)
    in_all = np.bincount(col, minlength=width)
    yes, no = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    odds = np.log((in_toxic + 0.5) / (yes + 1)) - np.log((in_all - in_toxic + 0.5) / (no + 1))
    gain = np.abs(odds) * np.sqrt(in_all)
    gain[in_all < LEAST_DOCS] = -1
    top = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    top = top[gain[top] > 0]
    marks = (odds > 3) & (in_all >= LEAST_DOCS)
    uses = np.bincount(row, times * marks[col], n)
    grade = np.where(toxic == 1, 1 + (uses >= 2) + (uses >= 5), 0).astype(int)
    place = np.full(width, -1)
    place[top] = np.arange(len(top))
    keep = place[col] >= 0 if len(top) else np.zeros(len(col), bool)
    weights, thresholds = fit_ordinal(row[keep], place[col[keep]], grade, len(top))
    return OrdinalModel(vocabulary[top], weights, thresholds)


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most `size` labelled rows, at most half of either class.

    The ids are chosen from the labels alone, by hash, so no text moves but those of the sample;
    of these, in the hash's order, as many as SAMPLE_BYTES hold.
    """
    ids = labels.select(pick(labels, "doc_id", "long").alias("doc_id"), pick(labels, label, "int").alias("y")).dropna().filter("y in (0, 1)").dropDuplicates(["doc_id"])
    parts = [ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2) for y in (0, 1)]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for p in parts for r in p.collect()], "doc_id long, y int")
    found = core(docs).join(F.broadcast(chosen), "doc_id").select("*", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("size"))
    upto = F.sum("size").over(Window.orderBy("h", "doc_id", "text"))
    got = found.orderBy("h", "doc_id", "text").limit(2 * size).withColumn("upto", upto).filter(F.coalesce("upto", F.lit(0)) <= SAMPLE_BYTES).orderBy("doc_id", "text").select("text", "y").toArrow()
    return got.column("text").to_pylist(), got.column("y").to_numpy().astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    model = train(*sample(docs, labels, "toxic"))
    release()
    return model


def _grades(model: OrdinalModel, texts: pa.Array) -> np.ndarray:
    latent = [model.latent(data, offsets) for _, _, data, offsets in th.chunks(texts, 1 << 20)]
    return model.grades(np.concatenate(latent)) if latent else np.zeros((0, len(model.thresholds) + 1))


def _score(model: OrdinalModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _grades(model, batch.column(1))
            severity = p @ np.arange(p.shape[1])
            grade = np.sum(np.cumsum(p[:, :-1], axis=1) < 0.5, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(1 - p[:, 0]), pa.array(grade.astype(np.int32))], ["doc_id", "severity", "p_toxic", "grade"])

    return score


def _clean(model: OrdinalModel, text: int, width: int):
    """The first `width` columns of the rows whose text (column `text`) isn't toxic."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
            yield own.filter(pa.array(1 - _grades(model, batch.column(text))[:, 0] < TOXIC))

    return clean


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (median) of every row; toxic: p_toxic >= 0.5.

    One pass without a shuffle. A null or empty text has no features and so the severity of
    the thresholds alone; repeated rows repeat, an empty table gives no rows, other columns
    of docs aren't read.
    """
    out = core(docs).mapInArrow(tidy(_score(model)), "doc_id long, severity double, p_toxic double, grade int")
    return out.withColumn("toxic", F.col("p_toxic") >= TOXIC)


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs' rows that aren't toxic, with docs' own columns; order and repeats stay.

    A null or empty text is judged by the thresholds alone, as a table without texts is; an
    empty table stays empty. A row crosses to Python once and comes back only if it stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    schema = own.schema
    if "text" in docs.columns and docs.schema["text"].dataType == StringType():
        text = docs.columns.index("text")
    else:
        own, text = own.withColumn("text", pick(docs, "text", "string") if "text" not in docs.columns else F.col(names[docs.columns.index("text")]).cast("string")), len(names)
    return own.mapInArrow(tidy(_clean(model, text, len(names))), schema).toDF(*docs.columns)
