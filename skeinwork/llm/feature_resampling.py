"""Resampling towards a target distribution: importance weights from a dictionary of n-gram features."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import text_hash as th
from skeinwork.llm.common import pick, release, stored, tidy

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Bytes of texts whose features are counted together before they move, and of those weighed together; words of them at most: their numbers fit 21 bits.
CHUNK, WEIGHED, SEGMENT = 12 << 20, 3 << 20, (1 << 21) - LONGEST
#: Bytes of text whose features one part of the dictionary takes, about.
PER_PART = 4 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes part words, and what each byte counts as: words are digits, ASCII letters in lower case and all other characters."""
    part = np.ones(256, bool)
    part[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return part, lower


PARTING, LOWER = _tables()


class Segment:
    """Features of some neighbouring words: each is up to LONGEST word numbers, packed; a vocabulary in byte order numbers them from 1."""

    def __init__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray, doc: np.ndarray, starts: int) -> None:
        """Features start in the first `starts` words; the words after those only end them."""
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]
        self.spelt = pa.array([None, *self.words], pa.binary())
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(1, len(words) + 1)
        w = rank[number]
        del raw, first, number, rank
        places = [np.flatnonzero(doc[: max(len(doc) - n + 1, 0)] == doc[n - 1 :])[:starts].astype(np.int32) for n in range(1, LONGEST + 1)]
        places = [at[at < starts] for at in places]
        self.keys, self.docs, k = np.zeros(sum(map(len, places)), np.int64), np.empty(sum(map(len, places)), np.int32), 0
        for n, at in enumerate(places, 1):
            for i in range(n):
                self.keys[k : k + len(at)] |= w[at + i] << (21 * (LONGEST - 1 - i))
            self.docs[k : k + len(at)] = doc[at]
            k += len(at)

    @staticmethod
    def numbers(keys: np.ndarray) -> list[np.ndarray]:
        return [(keys >> (21 * (LONGEST - 1 - i))) & ((1 << 21) - 1) for i in range(LONGEST)]

    def strings(self, keys: np.ndarray, end: bytes = b"") -> pa.Array:
        """Features' words, joined by one space, with what ends each."""
        joined = pc.binary_join_element_wise(*[self.spelt.take(pa.array(n)) for n in self.numbers(keys)], b" ", null_handling="skip")
        return pc.binary_join_element_wise(joined, end, b"") if end else joined

    def crc32(self, keys: np.ndarray) -> np.ndarray:
        """crc32 of each feature's string, from those of its words: a text's crc goes on through further bytes by
        a linear map that depends on their number alone, and the crc of those bytes."""
        size = np.array([0, *map(len, self.words)], np.int64) + 1
        alone = np.array([0, *map(zlib.crc32, self.words)], np.uint32)
        after = np.array([0, *(zlib.crc32(b" " + w) for w in self.words)], np.uint32)
        first, *more = self.numbers(keys)
        out = alone[first]
        for n in more:
            length = np.where(n > 0, size[n], 0)
            for k in np.unique(length[n > 0]):
                at = np.flatnonzero(length == k)
                zeros = bytes(int(k))
                bits = np.array([zlib.crc32(zeros, 1 << i) ^ zlib.crc32(zeros) for i in range(32)], np.uint32)
                moved = np.zeros(len(at), np.uint32)
                value = out[at]
                for byte in range(4):
                    table = np.zeros(256, np.uint32)
                    for i in range(8):
                        table[1 << i : 2 << i] = table[: 1 << i] ^ bits[8 * byte + i]
                    moved ^= table[(value >> np.uint32(8 * byte)) & np.uint32(255)]
                out[at] = moved ^ after[n[at]]
        return out


def segments(column: pa.Array, chunk: int) -> Iterator[tuple[int, int, np.ndarray, Segment | None]]:
    """First row, end row, words of each of these rows and features of them, piece by piece; the rows of a long text come several times."""
    tables = (PARTING, th.blanks_table()[1])
    for i, j, data, offsets in th.chunks(column, chunk):
        data = LOWER[data]
        s, e, hashes, _ = th.words(data, offsets[:-1], tables)
        doc = np.searchsorted(offsets, s, side="right") - 1
        none = np.zeros(j - i, np.int64)
        for a in range(0, max(len(s), 1), SEGMENT):
            b, end = min(a + SEGMENT, len(s)), min(a + SEGMENT + LONGEST - 1, len(s))
            words = np.bincount(doc[a:b], minlength=j - i) if b > a else none
            yield i, j, words, Segment(data, s[a:end], e[a:end], hashes[a:end], doc[a:end], b - a) if b > a else None


def _counted(parts: int):
    """A chunk's distinct features with their counts, dealt over the dictionary's parts by their words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            for _, _, _, found in segments(batch.column(0), CHUNK):
                if found is None:
                    continue
                keys, counts = np.unique(found.keys, return_counts=True)
                del found.keys, found.docs
                counts = counts.astype(np.uint32)
                word = np.array([0, *(zlib.crc32(w) for w in found.words)], np.uint64)
                where = np.zeros(len(keys), np.uint64)
                for n in found.numbers(keys):
                    where = th.mix(where * np.uint64(3) + word[n])
                where = (where % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
                by = np.argsort(where, kind="stable").astype(np.uint32)  # a part's features stay in order: their beginnings repeat
                cuts = np.searchsorted(where[by], np.arange(parts + 1))
                del where
                rows = []
                for p in np.flatnonzero(np.diff(cuts)):
                    at = by[cuts[p] : cuts[p + 1]]
                    rows.append((int(p), pack(found.strings(keys[at], b"\n").buffers()[2]), pack(counts[at].view(np.uint8).reshape(-1, 4).T.tobytes())))
                    if len(rows) == 64:
                        yield _rows(rows)
                        rows = []
                del found, keys, counts, by
                if rows:
                    yield _rows(rows)
                release()

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, strings, counts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(strings, pa.binary()), pa.array(counts, pa.binary())], ["part", "strings", "counts"])


def _planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the features' counts by bucket: a part's strings are counted, and each distinct one is hashed once."""
    sums = np.zeros(BUCKETS, np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[tuple] = []

    def flush() -> None:
        if not held:
            return
        data = b"".join(unpack(x) for x, _ in held)
        offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1])
        counts = np.concatenate([_planes(unpack(c)) for _, c in held])
        held.clear()
        strings = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])  # each with its line feed
        known = strings.dictionary_encode()
        times = np.bincount(known.indices.to_numpy(), weights=counts, minlength=len(known.dictionary)).astype(np.int64)
        crc = np.fromiter(map(zlib.crc32, pc.binary_slice(known.dictionary, 0, -1).to_numpy(zero_copy_only=False)), np.uint32, len(known.dictionary))
        sums[:] += np.bincount(crc % BUCKETS, weights=times, minlength=BUCKETS).astype(np.int64)

    part = None
    for batch in batches:
        for p, strings, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                flush()
                part = p
            held.append((strings, counts))
    flush()
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of features in each bucket, from one dictionary of all distinct features of the texts.

    texts: one column, text. Features are counted within a chunk of texts, their strings move
    once to the part of the dictionary that takes them, are counted over all chunks there, and
    each is hashed once. What reaches the driver are the buckets' sums.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PER_PART))
    dealt = texts.mapInArrow(tidy(_counted(parts)), "part int, strings binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    sums = dealt.mapInArrow(tidy(_hashed), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the logarithm of how much likelier the target makes it, in thousandths."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + BUCKETS) / ((x + 1) * (t + BUCKETS)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(gain: np.ndarray):
    """A document's features are counted by their numbers in the chunk's dictionary, whose strings' buckets bring in the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j, n, found in segments(batch.column(1), WEIGHED):
                words[i:j] += n
                if found is None:
                    continue
                place, distinct = pd.factorize(found.keys)
                own = gain[found.crc32(distinct) % BUCKETS].astype(float)[place]  # sums of whole numbers below 2^53 are exact
                features[i:j] += np.bincount(found.docs, minlength=j - i)
                weight[i:j] += np.bincount(found.docs, weights=own, minlength=j - i).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number of an id, in thousandths: adding it to weights turns the highest into a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, fewest_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null for what isn't drawn.

    docs: doc_id, text; target: text. Features are all runs of up to LONGEST neighbouring words.
    A bucket's gain follows from how often its features are met in docs and in target; a
    document's weight is its features' sum of gains. Of the rows with at least fewest_words words,
    percent in a hundred (rounded down) with the highest scores are drawn, ties to the smaller
    doc_id, then as the rows come. Ranks are told by a sort over ranges: no task holds all rows.

    A null or empty text has no words: no features, weight 0. A null doc_id has no score and
    isn't drawn (and isn't counted among those drawn from). Repeated rows are rows of their own.
    A text longer than a chunk is read in pieces, its features whole. Empty tables give no rows
    or, as target, gains that only follow from docs. Other columns aren't read.
    """
    texts = docs.select(pick(docs, "doc_id", "long").alias("doc_id"), pick(docs, "text", "string").alias("text"))
    gain = gains(bucket_counts(texts.select("text")), bucket_counts(target.select(pick(target, "text", "string").alias("text"))))
    weighed = texts.mapInArrow(tidy(_weighed(gain)), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    eligible = (F.col("n_words") >= fewest_words) & F.col("doc_id").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()]
    ranged = scored.filter(eligible).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = stored(ranged, "resample-ranged")
    # The upper bits of a place are its range, the lower ones count within it.
    before, sizes = [], ranged.groupBy(F.shiftright("place", 33).alias("range")).count().orderBy("range").collect()  # a row for each range
    total = 0
    for r in sizes:
        before.append((r["range"], total))
        total += r["count"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "range long, before long"))
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranged.join(starts, F.shiftright("place", 33) == F.col("range")).withColumn("rank", F.when(place <= percent * total // 100, place))
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(~F.coalesce(eligible, F.lit(False)))
    return ranked.select(*cols, "rank").unionByName(rest.select(*cols, F.lit(None).cast("long").alias("rank")))
