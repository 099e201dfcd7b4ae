"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import text_hash as th
from skeinwork.llm.common import core, pick, release, tidy
from skeinwork.llm.toxicity import sample

#: Labelled rows the field is fitted on, at most half of either class.
SAMPLE = 4000
#: A line is good (1) or bad (0); predicted documents are those of at least this score.
KEEP = 0.7


def _flags() -> np.ndarray:
    """By byte: upper case, lower case (all bytes of other alphabets count), digit, blank, full stop or comma, other sign."""
    out = np.zeros((6, 256), np.uint8)
    for b in range(256):
        c = chr(b)
        kind = 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" or b >= 128 else 2 if "0" <= c <= "9" else 3 if c in " \t\x0b\x0c\r\n" else 4 if c in ".,;:'-" else 5
        out[kind, b] = 1
    return out


_FLAGS = _flags()
_CUTS = {"upper": (0.15, 0.4, 0.7), "digit": (0.05, 0.2, 0.5), "sign": (0.02, 0.05, 0.1, 0.2, 0.4), "stop": (0.002, 0.05, 0.15), "same": (0.05, 0.2, 0.5, 0.8), "mean": (2.5, 4.0, 6.0, 9.0, 14.0), "long": (20, 80, 250, 800), "fresh": (0.3, 0.6, 0.85)}


#: Lines and bytes whose features are computed at once; a longer line is a block of its own.
BLOCK_LINES, BLOCK_BYTES = 1 << 15, 1 << 20
#: Lines from which a text's chain is cut into pieces whose transitions are multiplied.
LONG = 1024
#: Features of a line that its neighbours see too.
OWN = sum(map(len, _CUTS.values()))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every line of a chunk of texts: each text has a line more than line feeds."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    count = np.bincount(np.searchsorted(offsets, feeds, side="right") - 1, minlength=n) + 1
    doc = np.repeat(np.arange(n), count)
    first = np.cumsum(count) - count
    starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    inner = np.ones(len(doc), bool)
    inner[first] = False
    starts[first], starts[inner] = offsets[:-1], feeds + 1
    inner[:] = True
    inner[first + count - 1] = False
    ends[first + count - 1], ends[inner] = offsets[1:], feeds
    return doc, starts, ends


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Steps of shares of bytes and words of lines that follow each other in data, a column each."""
    size = ends - starts
    base = np.maximum(size, 1).astype(float)

    def share(kind: int) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_FLAGS[kind][data], dtype=np.int32, out=c[1:])
        return (c[ends] - c[starts]) / base

    s, _, h, _ = th.words(data, starts, th.blanks_table(lower=True))
    line = np.searchsorted(starts, s, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.bincount(line[1:], (h[1:] == h[:-1]) & (line[1:] == line[:-1]), len(starts)) / np.maximum(words, 1)
    by = np.lexsort((h, line))
    h, line = h[by], line[by]
    new = np.ones(len(s), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    fresh = np.bincount(line, new, len(starts)) / np.maximum(words, 1)
    values = {"upper": share(0), "digit": share(2), "sign": share(5), "stop": share(4), "same": same, "mean": (1 - share(3)) * base / np.maximum(words, 1), "long": size, "fresh": np.where(words < 8, 1.0, fresh)}
    return [values[k] > cut for k, cuts in _CUTS.items() for cut in cuts]


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray]]]:
    i = 0
    while i < len(starts):
        j = min(i + BLOCK_LINES, max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right"))))
        a = starts[i]
        yield slice(i, j), own_features(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j


def _edges(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line is its text's first, and its last."""
    other = np.ones(len(doc) + 1, bool)
    other[1:-1] = doc[1:] != doc[:-1]
    return other[:-1], other[1:]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, length in bytes and features of every line: its own, those of the lines before and after, its place."""
    doc, starts, ends = lines(data, offsets)
    own = np.zeros((len(doc), OWN), np.float32)
    for at, columns in _blocks(data, starts, ends):
        own[at] = np.stack(columns, axis=1)
    first, last = _edges(doc)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return doc, ends - starts, np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))]).astype(np.float32)


def _after(x: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """log sum over states a of exp(x[..., a] + steps[a, b]), for both b."""
    return np.logaddexp(x[..., 0, None] + steps[0], x[..., 1, None] + steps[1])


def _chains(own: np.ndarray, first: np.ndarray, count: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward scores of chains, all at once: step t handles line t of every chain that has one."""
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    alpha, beta = np.zeros_like(own), np.zeros_like(own)
    alive = [int(np.searchsorted(-count, -t, side="right")) for t in range(1, int(count.max(initial=0)) + 1)]
    for t, k in enumerate(alive):
        i = first[:k] + t
        alpha[i] = own[i] + (_after(alpha[i - 1], steps) if t else 0)
    for t in range(len(alive) - 2, -1, -1):
        i = first[: alive[t + 1]] + t
        beta[i] = _after(beta[i + 1] + own[i + 1], steps.T)
    return alpha, beta


def _long_chain(own: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long chain in some sqrt(n) steps: pieces are summed up to 2 x 2 matrices first."""
    n = len(own)
    size = int(np.sqrt(n))
    pieces = (n - 1) // size
    grid = own[1 : 1 + pieces * size].reshape(pieces, size, 2)
    whole = np.tile(steps, (pieces, 1, 1)) + grid[:, 0, None, :]
    for t in range(1, size):
        whole = _after(whole, steps) + grid[:, t, None, :]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[0] = own[0]
    enter = np.zeros((pieces + 1, 2))
    enter[0] = own[0]
    for p in range(pieces):
        enter[p + 1] = _after(enter[p], whole[p])
    now, at = enter[:-1], 1 + np.arange(pieces) * size
    for t in range(size):
        now = _after(now, steps) + grid[:, t]
        alpha[at + t] = now
    for i in range(1 + pieces * size, n):
        alpha[i] = _after(alpha[i - 1], steps) + own[i]
    for i in range(n - 2, pieces * size - 1, -1):
        beta[i] = _after(beta[i + 1] + own[i + 1], steps.T)
    leave = np.zeros((pieces + 1, 2))
    leave[pieces] = beta[pieces * size]
    for p in range(pieces - 1, -1, -1):
        leave[p] = _after(leave[p + 1], whole[p].T)
    beta[at - 1] = leave[:-1]
    now = leave[1:]
    for t in range(size - 1, 0, -1):
        now = _after(now + grid[:, t], steps.T)
        beta[at + t - 1] = now
    return alpha, beta


class LineField:
    """States 0 and 1; a state's score on a line is +-(features . weights) / 2, plus transitions."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.steps, self.slope, self.shift = weights, steps, slope, shift

    def _passes(self, doc: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the states, forward and backward scores of all lines, first line of each text."""
        own = np.stack([-u / 2, u / 2], axis=1).astype(float)
        first = np.flatnonzero(_edges(doc)[0]) if len(doc) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(doc)))
        short = count < LONG
        alpha, beta = _chains(own, first[short], count[short], self.steps)
        for a, n in zip(first[~short], count[~short]):
            alpha[a : a + n], beta[a : a + n] = _long_chain(own[a : a + n], self.steps)
        return own, alpha, beta, first

    def marginals(self, doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, summed pair marginals, log Z by forward-backward; doc: of each line, in order."""
        own, alpha, beta, first = self._passes(doc, x @ self.weights)
        both = alpha + beta
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
        pair = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                pair[a, b] = np.exp(alpha[inner, a] + self.steps[a, b] + own[inner + 1, b] + beta[inner + 1, b] - z[inner]).sum()
        return good, pair, float(z[first].sum()) if len(first) else 0.0

    def line_scores(self, data: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """features . weights of every line, block by block; a sum in the features' order, so the lines around change nothing."""
        own, before, after = self.weights[:OWN], self.weights[OWN : 2 * OWN], self.weights[2 * OWN : 3 * OWN]
        to_self, to_next, to_last = np.zeros(len(doc)), np.zeros(len(doc)), np.zeros(len(doc))
        for at, columns in _blocks(data, starts, ends):
            for k, column in enumerate(columns):
                to_self[at] += column * own[k]
                to_next[at] += column * before[k]
                to_last[at] += column * after[k]
        first, last = _edges(doc)
        u = to_self
        u[1:] += np.where(first[1:], 0.0, to_next[:-1])
        u[:-1] += np.where(last[:-1], 0.0, to_last[1:])
        return u + first * self.weights[-3] + last * self.weights[-2] + self.weights[-1]

    def score(self, data: np.ndarray, offsets: np.ndarray, calibrated: bool = True) -> np.ndarray:
        """Length-weighted mean of a text's marginals, calibrated."""
        doc, starts, ends = lines(data, offsets)
        _, alpha, beta, _ = self._passes(doc, self.line_scores(data, doc, starts, ends))
        alpha += beta
        good = 1 / (1 + np.exp(np.clip(alpha[:, 0] - alpha[:, 1], -700, 700)))
        weight = ends - starts + 1.0
        n = len(offsets) - 1
        mean = np.bincount(doc, weight * good, n) / np.bincount(doc, weight, n)
        return 1 / (1 + np.exp(-(self.slope * (mean - 0.5) + self.shift))) if calibrated else mean


def train(texts: list[str | None], quality: np.ndarray, share: np.ndarray | None = None, steps: int = 80, rate: float = 0.1) -> LineField:
    """Every line takes its document's label; weights and transitions by Adam on the likelihood.

    share: how many documents each sampled one stands for; it weighs the calibration.
    Without labelled texts every score is 0.5.
    """
    if not texts:
        width = line_features(*th.texts(pa.array([""])))[2].shape[1]
        return LineField(np.zeros(width), np.zeros((2, 2)))
    data, offsets = th.texts(pa.array(texts, pa.string()))
    doc, size, x = line_features(data, offsets)
    y = quality[doc]
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    n = max(1, len(y))
    p, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, steps + 1):
        field.weights, field.steps = p[:-4], p[-4:].reshape(2, 2)
        good, pair, _ = field.marginals(doc, x)
        g = np.concatenate([x.T @ (good - y) / n, ((pair - seen) / n).ravel()]) + 1e-3 * p
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field.weights, field.steps = p[:-4], p[-4:].reshape(2, 2)
    mean = field.score(data, offsets, calibrated=False) - 0.5
    w = np.ones(len(texts)) if share is None else share
    a, b = 4.0, 0.0
    for _ in range(500):
        q = 1 / (1 + np.exp(-(a * mean + b)))
        a -= 4 * (np.sum(w * (q - quality) * mean) / w.sum() + 1e-3 * a / 10)
        b -= 4 * np.sum(w * (q - quality)) / w.sum()
    field.slope, field.shift = max(a, 0.1), b
    return field


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> LineField:
    """A field fitted on a bounded sample of the labelled rows that aren't held out."""
    free = labels.filter(~held_out())
    texts, quality = sample(docs, free, "quality", size)
    counts = {r["y"]: r["count"] for r in free.groupBy(pick(free, "quality", "int").alias("y")).count().filter("y in (0, 1)").collect()}
    drawn = np.bincount(quality, minlength=2)
    field = train(texts, quality, np.array([counts[y] / drawn[y] for y in quality], float))
    del texts
    release()
    return field


def _score(field: LineField):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [field.score(data, offsets) for _, _, data, offsets in th.chunks(batch.column(1), 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one pass without a shuffle.

    A null or empty text is one empty line and gets its score; a line feed at a text's end opens
    an empty line of that text. The score of a text doesn't depend on the rows around it. A very
    long text's lines are read in blocks; some hundred bytes a line are held. Rows that repeat give repeated
    results, a null doc_id isn't held out, an empty table gives no rows, other columns of docs
    aren't read: the score follows from the text alone.
    """
    out = core(docs).mapInArrow(tidy(_score(field)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).cast("int").alias("predicted"))
