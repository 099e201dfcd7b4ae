"""Pairs of 64-bit numbers dealt by their first one, as blobs: a row per task and destination, not per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.common import tidy

PAIR = np.dtype([("key", "<u8"), ("c", "<u8")])
#: A key that so many pairs of one task have is passed on at once, so no task gathers a hot one.
HOT_IN_TASK = 64
#: Pairs a map task holds, and a joining one is meant to.
HELD, PER_TASK = 1 << 19, 1 << 21


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Sorted by key, then c; each pair once."""
    pairs = pairs[np.lexsort((pairs["c"], pairs["key"]))]
    if not len(pairs):
        return pairs
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs["key"][1:] != pairs["key"][:-1]) | (pairs["c"][1:] != pairs["c"][:-1])
    return pairs[new]


def _by_destination(pairs: np.ndarray, dest: np.ndarray, direct: bool) -> Iterator[tuple[int, bool, bytes]]:
    by = np.argsort(dest, kind="stable")
    pairs, dest = pairs[by], dest[by]
    at = np.flatnonzero(np.diff(dest, prepend=-1))
    for a, b in zip(at, [*at[1:], len(dest)]):
        yield int(dest[a]), direct, pairs[a:b].tobytes()


class Dealer:
    """Collects a map task's pairs and deals them out.

    A key that many pairs of the task have is certain to be shared: those pairs go on as they
    are (direct), and two of them stand for the rest where the key is joined.
    """

    def __init__(self, parts: int) -> None:
        self.parts, self.held, self.count = np.uint64(parts), [], 0

    def add(self, key: np.ndarray, c: int) -> Iterator[pa.RecordBatch]:
        rows = np.empty(len(key), PAIR)
        rows["key"], rows["c"] = key, np.int64(c).view(np.uint64)
        self.held.append(rows)
        self.count += len(key)
        if self.count >= HELD:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        pairs = _distinct(np.concatenate(self.held))
        self.held, self.count = [], 0
        start = np.flatnonzero(np.concatenate([[True], pairs["key"][1:] != pairs["key"][:-1]]))
        size = np.diff(np.append(start, len(pairs)))
        hot = np.repeat(size >= HOT_IN_TASK, size)
        stand = hot & (np.arange(len(pairs)) - np.repeat(start, size) < 2)
        joined, direct = pairs[~hot | stand], pairs[hot & ~stand]
        out = [*_by_destination(joined, (joined["key"] % self.parts).astype(np.int64), False), *_by_destination(direct, (direct["c"] % self.parts).astype(np.int64), True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], ["part", "direct", "pairs"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined, direct = [], []
    for batch in batches:
        for straight, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            (direct if straight else joined).append(np.frombuffer(blob, PAIR))
    out = np.concatenate(direct) if direct else np.zeros(0, PAIR)
    if joined:
        pairs = _distinct(np.concatenate(joined))
        start = np.flatnonzero(np.concatenate([[True], pairs["key"][1:] != pairs["key"][:-1]]))
        size = np.diff(np.append(start, len(pairs)))
        out = np.concatenate([out, pairs[np.repeat(size > 1, size)]])
    for i in range(0, len(out), 1 << 16):
        part = out[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part["key"].view(np.int64)), pa.array(part["c"].view(np.int64))], ["key", "c"])


def shared_pairs(rows: DataFrame, deal, parts: int) -> DataFrame:
    """(key, c) of every key that two different c or more have; deal yields a Dealer's batches."""
    dealt = rows.mapInArrow(tidy(deal), "part int, direct boolean, pairs binary")
    return dealt.repartition(parts, "part").mapInArrow(tidy(_shared), "key long, c long")
