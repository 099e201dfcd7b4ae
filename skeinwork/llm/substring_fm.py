"""Substring deduplication with compressed FM-indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import text_hash as th
from skeinwork.llm.blobs import PER_TASK, Dealer, shared_pairs
from skeinwork.llm.common import core, stored, tidy

#: Words of a window.
WINDOW = 50
#: Words of an anchor. Every window has the smallest anchor hash among its own as its mark.
ANCHOR = 16
#: Windows of a segment at most, and words of an index.
RUN, SHARD_WORDS = 64, 1 << 18
#: Segments a map task remembers, to send a segment's words once; answers in a batch.
SENT, ANSWERS = 1 << 16, 1 << 12
#: Bytes of a word and its blank, as shards are sized before their words are counted.
WORD_BYTES = 6


class Bits:
    """A packed bit vector with a count every 64 bits."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.counts = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), dtype=np.int32, out=self.counts[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, from 0."""
        word = np.searchsorted(self.counts, k, side="right") - 1
        left, rest, at = self.words[word], k - self.counts[word], word << 6
        for width in (32, 16, 8, 4, 2, 1):
            low = left & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low)
            beyond = rest >= ones
            rest = rest - np.where(beyond, ones, 0)
            at = at + np.where(beyond, width, 0)
            left = np.where(beyond, left >> np.uint64(width), low)
        return at


class WaveletMatrix:
    """Bit planes of a sequence of numbers: rank in a step per plane."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.planes, now = [], values
        for level in reversed(range(max(1, int(top).bit_length()))):
            bit = ((now >> level) & 1).astype(bool)
            self.planes.append((level, Bits(bit), int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` lands after all planes, following the symbol's bits."""
        for level, bits, zeros in self.planes:
            ones = bits.rank(at)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Index of segments of word numbers for patterns of up to WINDOW words.

    Suffixes are sorted by their first WINDOW words only (by doubling); a backward step needs
    no more, as it counts the suffixes before an interval and not their order. What is kept of
    n words: the wavelet matrix of their Burrows-Wheeler transform, two bit vectors of where
    suffixes differ in their first WINDOW - 1 and WINDOW words, and a 32-bit number of the least owner
    for each distinct window. Neither the text nor the suffixes are.
    """

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray) -> None:
        length = np.array([len(x) for x in segments])
        text = np.zeros(int(length.sum()) + len(length), np.int32)
        starts = np.cumsum(length + 1) - length - 1
        for at, x in zip(starts, segments):
            text[at : at + len(x)] = x
        n = len(text)

        def with_later(rank: np.ndarray, k: int) -> np.ndarray:
            out = rank.astype(np.int64) * (int(rank.max()) + 1)
            out[: max(n - k, 0)] += rank[k:]
            return out

        def renumbered(key: np.ndarray) -> np.ndarray:
            return np.unique(key, return_inverse=True)[1].astype(np.int32)

        rank, depth = text, 1
        while depth * 2 <= WINDOW:
            rank = renumbered(with_later(rank, depth))
            depth *= 2
        shorter = renumbered(with_later(rank, WINDOW - 1 - depth))
        whole = renumbered(with_later(rank, WINDOW - depth))
        del rank
        order = np.argsort(whole, kind="stable").astype(np.int32)

        def changes(ranks: np.ndarray) -> np.ndarray:
            ranks = ranks[order]
            return np.concatenate([[True], ranks[1:] != ranks[:-1], [True]])

        self.shorter = Bits(changes(shorter))
        edge = changes(whole)
        del shorter, whole
        self.whole = Bits(edge)
        self.n, top = n, int(text.max())
        self.bits = WaveletMatrix(text[order - 1], top)
        symbols = np.arange(top + 1)
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))[:-1]])
        self.shift = (below - self.bits.down(symbols, np.zeros(top + 1, np.int64))).astype(np.int32)
        self.owners, number = np.unique(owners, return_inverse=True)
        owner = np.repeat(number.astype(np.int32), length + 1)[order]
        self.least = np.minimum.reduceat(owner, np.flatnonzero(edge[:-1]))

    def least_owners(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each segment, the least owner of the segments that hold it.

        segments: some of those the index was built of. All are streamed at once, from their
        last word to their first. The interval of the match is widened to that of its first
        WINDOW - 1 words, then a backward step adds the word before it: the matching
        statistics, up to WINDOW.
        """
        length = np.array([len(x) for x in segments])
        by = np.argsort(-length, kind="stable")
        words = np.concatenate([segments[i] for i in by]).astype(np.int32)
        end = np.cumsum(length[by])
        span = np.array([np.zeros(len(by), np.int64), np.full(len(by), self.n)])
        out = np.zeros(len(words), np.int32)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length[by], -t, side="left"))
            at = end[:live] - 1 - t
            c, now = words[at], span[:, :live]
            if t >= WINDOW:
                group = self.shorter.rank(now[0] + 1)
                now = np.array([self.shorter.select(group - 1), self.shorter.select(group)])
            now = self.shift[c] + self.bits.down(np.concatenate([c, c]), now.ravel()).reshape(2, live)
            span[:, :live] = now
            if t >= WINDOW - 1:
                out[at] = self.least[self.whole.rank(now[0] + 1) - 1]
        result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(by)
        for i, e in zip(by, end):
            result[i] = self.owners[out[e - length[i] : e - WINDOW + 1]]
        return result


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _marks(column: pa.Array) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Of each text: the marks of its windows, its bytes, and starts and ends of its words."""
    for _, _, data, offsets in th.chunks(column):
        s, e, h, _ = th.words(data, offsets[:-1], th.blanks_table())
        at = np.searchsorted(s, offsets)
        g = th.grams(h, ANCHOR)
        least = _smallest(g, WINDOW - ANCHOR + 1) if len(h) >= WINDOW else np.zeros(0, np.uint64)
        for i, (a, z) in enumerate(zip(at[:-1], at[1:])):
            here = data[offsets[i] : offsets[i + 1]]
            yield least[a : max(a, z - WINDOW + 1)], here.tobytes(), s[a:z] - offsets[i], e[a:z] - offsets[i]


def _anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for batch in batches:
            for doc_id, (mark, *_) in zip(batch.column(0).to_pylist(), _marks(batch.column(1))):
                if doc_id is not None and len(mark):
                    yield from dealer.add(np.unique(mark), doc_id)
        yield from dealer.end()

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one shared mark: doc_id, start, seg, mark, words (once a task, else null)."""
    sent: set[bytes] = set()
    for batch in batches:
        out: list[tuple] = []
        for doc_id, version, shared, (mark, text, s, e) in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2), _marks(batch.column(1))):
            wanted = np.isin(mark, np.array(shared.as_py(), np.int64).view(np.uint64))
            edge = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else []
            for a, z in zip(edge, [*edge[1:], len(mark)]):
                if wanted[a]:
                    for i in range(a, z, RUN):
                        j = min(z, i + RUN)
                        words = b" ".join(text[x:y] for x, y in zip(s[i : j + WINDOW - 1], e[i : j + WINDOW - 1]))
                        seg = hashlib.blake2b(words, digest_size=16).digest()
                        if len(sent) > SENT:
                            sent.clear()
                        out.append((doc_id, version, int(i), seg, int(mark[i].view(np.int64)), None if seg in sent else words))
                        sent.add(seg)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "version", "start", "seg", "mark", "words"])


def _answers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """seg, owners of one shard's rows (seg, words, owner, last); segments without a smaller owner are left out."""
    number: dict[bytes, int] = {}
    segments = []
    for _, words, _, _ in rows:
        segments.append(np.array([number.setdefault(w, len(number) + 1) for w in words.split(b" ")], np.int32))
    del number
    found = FmIndex(segments, np.array([r[2] for r in rows], np.int64)).least_owners(segments)
    out = [(r[0], x) for r, x in zip(rows, found) if (x < r[3]).any()]
    for i in range(0, len(out), ANSWERS):
        part = out[i : i + ANSWERS]
        yield pa.RecordBatch.from_arrays([pa.array([seg for seg, _ in part], pa.binary()), pa.array([x for _, x in part], pa.list_(pa.int64()))], ["seg", "owners"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seg, owners: for each window of a segment the least doc_id of the shard that has it. Rows come by shard."""
    shard, rows = None, []
    for batch in batches:
        for now, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if now != shard:
                if rows:
                    yield from _answers(rows)
                shard, rows = now, []
            rows.append(tuple(row))
    if rows:
        yield from _answers(rows)


def _whole_windows(parts: int):
    """Hashes of whole windows, dealt with the number of their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for batch in batches:
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = th.words(np.frombuffer(words, np.uint8), np.zeros(1, np.int64), th.blanks_table())[2]
                yield from dealer.add(np.unique(th.grams(h, WINDOW)), number)
        yield from dealer.end()

    return run


def _kept(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if starts.is_valid:
                    at = np.array(starts.as_py(), np.int64)
                    cover = np.zeros(len(words) + WINDOW + 1, np.int32)
                    at = at[at + WINDOW <= len(words)]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
                    stay = np.cumsum(cover)[: len(words)] == 0
                    words = [w for w, s in zip(words, stay) if s]
                n_removed.append(n_words[-1] - len(words))
                rest = b" ".join(words)
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode())
            columns = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            columns |= {"kept_text": pa.array(kept, pa.string())} if with_text else {}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cut


def _heavy_rows(heavy: DataFrame, parts: int) -> DataFrame:
    """shard, seg, words, owner, last of the segments of marks that have more than an index holds.

    A segment that only one document has, and no window of which another segment has, is left
    out: a frequent line marks the windows around it, and most of them repeat nowhere. What
    stays of a mark is cut into parts of half an index; each pair of parts is an index of its own.
    """
    shared = shared_pairs(heavy.select("number", "words"), _whole_windows(parts), parts).select(F.col("c").alias("number")).distinct()
    alone = heavy.filter("last = owner").join(shared, "number", "left_semi")
    left = stored(heavy.filter("last > owner").unionByName(alone), "fm-heavy")
    half = WORD_BYTES * SHARD_WORDS // 2
    cuts = left.groupBy("mark").agg(F.ceil(F.sum(F.octet_length("words")) / half).cast("int").alias("cuts"))
    cuts = cuts.withColumn("cuts", F.when(F.col("cuts") <= 2, 1).otherwise(F.col("cuts")))
    dealt = left.join(cuts, "mark").withColumn("part", F.pmod(F.xxhash64("seg"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    shard = F.xxhash64("mark", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.select((-1 - F.pmod(shard, F.lit(1 << 62))).alias("shard"), "seg", "words", "owner", "last")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, version, starts: the words at which a window begins that a smaller doc_id has too.

    docs: doc_id, text, version (a hash of the text: rows that repeat a doc_id may differ).
    """
    spark = docs.sparkSession
    rows = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows["size"] or 0) // (100 * PER_TASK)))
    shared = shared_pairs(docs, _anchors(parts), parts)
    marks = shared.groupBy(F.col("c").alias("doc_id")).agg(F.collect_list("key").alias("marks"))
    segments = docs.join(marks, "doc_id").select("doc_id", "text", "marks", "version").mapInArrow(tidy(_segments), "doc_id long, version long, start int, seg binary, mark long, words binary")
    segments = stored(segments, "fm-segments")
    distinct = segments.groupBy("seg").agg(F.first("mark").alias("mark"), F.first("words", ignorenulls=True).alias("words"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    distinct = stored(distinct.withColumn("number", F.monotonically_increasing_id()), "fm-distinct")
    sizes = stored(distinct.groupBy("mark").agg(F.sum(F.octet_length("words")).alias("size")), "fm-marks")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    light = distinct
    shards = max(1, -(-total // (WORD_BYTES * SHARD_WORDS)))
    hot = sizes.filter(F.col("size") > WORD_BYTES * SHARD_WORDS).select("mark")
    some_hot = not hot.isEmpty()
    if some_hot:
        light = distinct.join(hot, "mark", "left_anti")
    dealt = light.select(F.pmod(F.xxhash64("mark"), F.lit(shards)).alias("shard"), "seg", "words", "owner", "last")
    if some_hot:
        dealt = dealt.unionByName(_heavy_rows(distinct.join(hot, "mark", "left_semi"), parts))
    # A task reads several shards, one after another.
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard")
    found = stored(dealt.mapInArrow(tidy(_search), "seg binary, owners array<long>"), "fm-found")
    mine = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = segments.select("doc_id", "version", "start", "seg").join(found, "seg").select("doc_id", "version", mine.alias("starts")).filter(F.size("starts") > 0)
    return hits.groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of docs.

    A window is 50 consecutive words; the words covered by a window that also starts in a
    document with a smaller doc_id go.

    1. Each window is marked with the smallest hash of the 16-word anchors inside it: equal
       windows have equal marks, and a mark lasts some eighteen windows. Marks that two
       documents or more have are found in one exchange of marks.
    2. Runs of windows with one shared mark are the segments; equal segments are merged and
       dealt into shards by mark, so that equal windows meet in one shard.
    3. Each shard builds an FM-index of its segments: a wavelet matrix over their
       Burrows-Wheeler transform. Segments are streamed through it by backward search, whose
       interval after 50 words gives the least doc_id that has the window.
    4. Documents get their windows back and are cut.
    A shard holds about SHARD_WORDS words and a mark's segments stay together. A mark with more
    segments than that has them thinned by the hashes of their whole windows and, if need be,
    indexed in pairs of parts. What a document gathers is bounded by its own length.

    A null or empty text has no words. Texts of fewer than 50 words keep all. A null doc_id is
    neither compared nor cut. A very long text costs its own words a few times over. Rows that repeat a doc_id, with one text or several, aren't
    smaller than each other; each is cut by its own text. An empty table gives no rows, other
    columns of docs aren't read.
    """
    docs = core(docs).withColumn("version", F.xxhash64("text"))
    both = docs.join(repeated_windows(docs), ["doc_id", "version"], "left").select("doc_id", "text", "starts")
    return both.mapInArrow(tidy(_kept(with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
