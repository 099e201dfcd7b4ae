"""N-gram Jaccard self-join by filtering under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from skeinwork.llm import text_hash as th
from skeinwork.llm.blobs import PER_TASK, Dealer, shared_pairs
from skeinwork.llm.common import core, pick, stored, tidy
from skeinwork.llm.components import components

WORDS = 5
#: Two sets link when PARTS * intersection >= NEED * union.
NEED, PARTS = 80, 100
#: Prefixes are this share of a set longer than one shared token asks for, and must share as many tokens more.
EXTRA = 0.1
#: Counts of the most frequent tokens that the orders know; all others count as rare.
FREQUENT, LEAST_IN_BATCH = 1 << 21, 2
#: Rows whose tokens are counted together before they are passed on.
COUNTED_ROWS = 4096
#: Tokens of a block that are verified together; larger blocks are verified in pairs of parts.
BLOCK_TOKENS = 1 << 22
ORDERS = (0x1234567, 0x7654321, 0x3C6EF35F)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens a set of n shares with any set it links to."""
    return -(-NEED * n // PARTS)


def prefix_length(n: int, extra: int) -> int:
    return min(n, n - int(least_overlap(n)) + extra)


def wanted_shared(n: int) -> int:
    """Prefix tokens that a set of n shares with any set it links to.

    With prefixes of n - overlap + k tokens two linked sets share k at least, where k is that
    of the smaller one, which has no fewer than least_overlap(n) tokens.
    """
    return min(int(EXTRA * int(least_overlap(n))) + 1, n)


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    tables = th.blanks_table(lower=True)
    for _, _, data, offsets in th.chunks(column):
        s, _, h, _ = th.words(data, offsets[:-1], tables)
        at = np.searchsorted(s, offsets)
        g = th.grams(h, k)
        for a, z in zip(at[:-1], at[1:]):
            if z - a >= k:
                yield np.unique(g[a : z - k + 1])
            elif z > a:
                yield np.array([th.sequence(h[a:z])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(tokens: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    a = np.sum(th.mix(tokens ^ np.uint64(0x51ED270B)), dtype=np.uint64) + np.uint64(len(tokens))
    b = np.sum(th.mix(tokens ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def _class(sig: bytes | None) -> int | None:
    """A class's number while candidates are sought; two classes of one number only add candidates."""
    return None if sig is None else int.from_bytes(sig[:8], "little", signed=True)


class Orders:
    """Total orders of all tokens: rare before frequent, then by a hash of the order's own.

    Any order gives whole results; the counts only decide how many candidates there are.
    """

    def __init__(self, tokens: np.ndarray, ranks: np.ndarray) -> None:
        by = np.argsort(tokens)
        self.tokens, self.ranks = tokens[by], ranks[by].astype(np.uint64)

    def keys(self, tokens: np.ndarray, order: int) -> np.ndarray:
        key = th.mix(tokens ^ np.uint64(ORDERS[order])) >> np.uint64(1)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            known = self.tokens[at] == tokens
            key[known] = np.uint64(1 << 63) | self.ranks[at[known]]
        return key

    def prefix(self, tokens: np.ndarray, order: int) -> np.ndarray:
        n = len(tokens)
        p = prefix_length(n, int(EXTRA * n) + 1)
        keys = self.keys(tokens, order)
        return np.partition(keys, p - 1)[:p] if p < n else keys


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (doc_id, n, sig) and a row per token that is frequent in its batch (token, times)."""
    names = ["doc_id", "n", "sig", "c", "token", "times"]
    for batch in (b.slice(i, COUNTED_ROWS) for b in batches for i in range(0, b.num_rows, COUNTED_ROWS)):
        n, sig, seen = [], [], []
        for x in shingle_sets(batch.column(1)):
            n.append(len(x))
            sig.append(signature(x) if len(x) else None)
            seen.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array([_class(x) for x in sig], pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names)
        token, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        some = times >= LEAST_IN_BATCH
        k = int(some.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(token[some].view(np.int64)), pa.array(times[some].astype(np.int64))], names)


def _prefixes(orders, parts: int):
    """Prefix tokens under the first order with their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dealer = orders.value, Dealer(parts)
        for batch in batches:
            for x in shingle_sets(batch.column(1)):
                if len(x):
                    yield from dealer.add(known.prefix(x, 0), _class(signature(x)))
        yield from dealer.end()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token sets of the wanted classes; a row of another text under the same doc_id is left out."""
    for batch in batches:
        out = [(i, sig, x) for i, (x, sig) in enumerate(zip(shingle_sets(batch.column(0)), batch.column(1).to_pylist())) if len(x) and signature(x) == sig]
        rows = batch.take(pa.array([i for i, _, _ in out], pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(3), pa.array([x.tobytes() for _, _, x in out], pa.binary())], ["sig", "rep", "block", "tokens"])


def linked(sets: list[np.ndarray], known: Orders, left: np.ndarray | None = None) -> np.ndarray:
    """Component of each set (its smallest member's place) among linked sets.

    Candidates of a set share enough prefix tokens with it under each order: the counts under
    the orders are intersected, then the overlap of what remains is counted exactly. Sets that
    already share a component aren't compared again. left: only pairs of a set that is left
    with one that isn't are compared.
    """
    m = len(sets)
    n = np.array([len(x) for x in sets])
    need = np.array([wanted_shared(int(x)) for x in n])
    prefixes = [[known.prefix(x, o) for x in sets] for o in range(len(ORDERS))]

    def posting(lists: list[np.ndarray], members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([lists[i] for i in members])
        who = np.repeat(np.arange(len(members)), [len(lists[i]) for i in members])
        by = np.argsort(key, kind="stable")
        return key[by], who[by]

    def counts(index: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, size: int) -> np.ndarray:
        lo, hi = np.searchsorted(index[0], tokens, "left"), np.searchsorted(index[0], tokens, "right")
        span = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        return np.bincount(index[1][at], minlength=size)

    parent = np.arange(m)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def index_of(members: np.ndarray) -> tuple:
        return members, [posting(p, members) for p in prefixes], posting(sets, members)

    def partners(a: int, index: tuple, open_: np.ndarray) -> np.ndarray:
        members, orders, whole = index
        near = open_[members] & (n[members] * PARTS >= NEED * n[a]) & (n[a] * PARTS >= NEED * n[members])
        for o, order in enumerate(orders):
            near &= counts(order, prefixes[o][a], len(members)) >= np.minimum(need[a], need[members])
        if near.any():
            both = counts(whole, sets[a], len(members))
            near &= PARTS * both >= NEED * (n[a] + n[members] - both)
        return members[near]

    if left is not None and not (left.any() and (~left).any()):
        return parent
    if left is not None:
        index, open_ = index_of(np.flatnonzero(~left)), ~left
        for a in np.flatnonzero(left):
            for b in partners(int(a), index, open_):
                x, y = find(int(a)), find(int(b))
                parent[max(x, y)] = min(x, y)
        return np.array([find(i) for i in range(m)])

    # Breadth first: a set that has been reached need not be found again.
    waiting, queue, index = np.ones(m, bool), [], index_of(np.arange(m))
    while waiting.any():
        if waiting.sum() * 2 < len(index[0]):
            index = index_of(np.flatnonzero(waiting))
        a = queue.pop() if queue else int(np.flatnonzero(waiting)[0])
        waiting[a] = False
        for b in partners(a, index, waiting):
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
            waiting[b] = False
            queue.append(int(b))
    return np.array([find(i) for i in range(m)])


def _verify(orders):
    """Links found in each (block, x, y): sig, rep, to (rep of the smallest linked), split."""

    def flush(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[2]): r for r in sorted(rows, key=lambda r: r[1])}.values())
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        left = None if key[1] == key[2] else np.array([r[2] == key[1] for r in rows])
        found = linked(sets, orders.value, left)
        out = [(r[0], r[1], rows[c][1], rows[c][0]) for r, c in zip(rows, found) if rows[c][0] != r[0]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["sig", "rep", "to", "to_sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for block, x, y, sig, rep, part, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, x, y) != key:
                    if len(rows) > 1:
                        yield flush(key, rows)
                    key, rows = (block, x, y), []
                rows.append((sig, rep, part, tokens))
        if len(rows) > 1:
            yield flush(key, rows)

    return run


def frequent_tokens(counts: DataFrame, most: int | None = None) -> Orders:
    """Orders that know the most frequent tokens, at most `most` of them.

    The least count that is known follows from a histogram of count levels (eight to a
    doubling, so some hundreds of rows), and only tokens from there on reach the driver.
    """
    counts = stored(counts.withColumn("level", F.floor(8 * F.log2("times"))), "join-counts")
    left, least = FREQUENT if most is None else most, None
    for level, n in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = level
    if least is None:
        return Orders(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    known = counts.filter(F.col("level") >= least).select("token", "times").toArrow()
    tokens, times = (known.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in (0, 1))
    by = np.lexsort((tokens, times))
    return Orders(tokens[by].view(np.uint64), np.arange(1, len(by) + 1))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Sets are the distinct 5-word shingles of the lower-cased text, by 64-bit hash (a shorter
    text is one shingle); two link at a Jaccard similarity of 0.8 or more; component_id is the
    smallest doc_id that links reach.

    1. One pass gives each row its set's size and signature and counts frequent tokens. Rows
       of one set form a class, which stands for them all from here on.
    2. Each class's prefix under a global order (rare tokens first) is dealt by token. A linked
       class shares several prefix tokens with its partner, so classes with fewer shared ones
       are dropped, and of the others' shared tokens only the rarest, by their exact number of
       classes, propose candidates. What still shares a token forms a block.
    3. The sets of the blocks' classes are fetched once; within a block, candidates must share
       enough prefix tokens under every one of several orders before their overlap is counted.
       A block beyond BLOCK_TOKENS is cut into parts, each pair of which is a task.
    No pairs are listed: tasks report links that join components. A hot token's rows bypass
    the task that joins it, groups of equal sets by their class.

    A null or empty text, or one of blanks, has no shingles, is linked with nothing and its
    component is its own doc_id. Rows with a null doc_id get a null component and link nothing
    else. Rows that repeat a doc_id with one text repeat in the result; a doc_id with several
    texts is in the component of each row's own text. An empty table gives no rows, other
    columns of docs aren't read.
    """
    return _labelled(docs).drop("sig")


def _labelled(docs: DataFrame) -> DataFrame:
    """jaccard_components' rows, with the signature of each row's set."""
    spark = docs.sparkSession
    docs = core(docs)
    profile = stored(docs.mapInArrow(tidy(_profile), "doc_id long, n long, sig binary, c long, token long, times long"), "join-profile")
    light = profile.filter("n is not null").select("doc_id", "n", "sig", "c")
    orders = spark.sparkContext.broadcast(frequent_tokens(profile.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times"))))

    classes = light.filter("sig is not null and doc_id is not null").groupBy("sig", "c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = stored(classes, "join-classes")

    total = light.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (3 * PER_TASK)))
    live = stored(shared_pairs(docs, _prefixes(orders, parts), parts), "join-shared")
    wanted = F.least(F.floor(F.lit(EXTRA) * F.ceil(F.lit(NEED) * F.col("n") / PARTS)) + 1, F.col("n"))
    sizes = classes.groupBy("c").agg(F.min(wanted).alias("wanted"))
    kept = live.groupBy("c").count().join(sizes, "c").filter("count >= wanted").select("c")
    live = stored(live.join(kept, "c", "left_semi").distinct(), "join-live")
    # Linked classes share `wanted` of these keys, so one at least that isn't among either's most frequent ones.
    frequency = live.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    by_class = Window.partitionBy("c")
    ranked = live.join(frequency, "key").join(sizes, "c").withColumns({"place": F.row_number().over(by_class.orderBy("df", "key")), "keys": F.count("*").over(by_class)})
    live = stored(ranked.filter("place <= keys - wanted + 1").select("key", "c"), "join-live")
    stars = live.groupBy("key").agg(F.min("c").alias("a"))
    blocks = components(live.join(stars, "key").select("a", F.col("c").alias("b")).filter("a <> b").distinct())

    members = stored(classes.join(blocks.select(F.col("node").alias("c"), F.col("label").alias("block")), "c").select("sig", "rep", "n", "block"), "join-members")
    cuts = members.groupBy("block").agg(F.sum("n").alias("tokens"), F.count("*").alias("classes")).filter("classes > 1").select("block", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("cuts"))
    fetched = docs.hint("merge").join(members.join(cuts.select("block"), "block", "left_semi").select(F.col("rep").alias("doc_id"), "sig", "block"), "doc_id").select("text", "sig", F.col("doc_id").alias("rep"), "block")
    sets = stored(fetched.mapInArrow(tidy(_sets), "sig binary, rep long, block long, tokens binary"), "join-sets")
    # Part p of a block of k parts meets each part q in the task (min, max).
    dealt = sets.join(cuts, "block").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("block", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "sig", "rep", "part", "tokens", "cuts")
    tasks = dealt.drop("cuts").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")
    links = stored(tasks.mapInArrow(tidy(_verify(orders)), "sig binary, rep long, to long, to_sig binary"), "join-links")
    orders.unpersist()
    split = cuts.filter("cuts > 1")
    if split.isEmpty():
        labels = links.select("sig", F.col("to").alias("label"))
    else:
        # Parts of a block each know some of its links. Classes may share a rep (a doc_id with several texts), so nodes are signatures.
        nodes = components(links.select(F.col("sig").alias("a"), F.col("to_sig").alias("b")))
        least = nodes.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
        labels = least.join(least.groupBy("label").agg(F.min("rep").alias("least")), "label").select(F.col("node").alias("sig"), F.col("least").alias("label"))
    found = classes.join(labels, "sig", "left").select("sig", F.least("rep", F.coalesce("label", "rep")).alias("found"))
    out = light.join(found, "sig", "left")
    return out.select("doc_id", "sig", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))


@F.pandas_udf(BinaryType())
def _signature_of(text: pd.Series) -> pd.Series:
    return pd.Series([signature(x) if len(x) else None for x in shingle_sets(pa.array(text, pa.string()))], text.index, object)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs' rows, with docs' own columns, of which one a component stays: that of the smallest doc_id.

    Rows whose doc_id has one text, or several that all go, are told by doc_id alone; where
    only some of a doc_id's texts go, its rows are told apart by their sets' signatures. Rows
    with a null doc_id, and those without words, all stay; an empty table stays empty.
    """
    rows = stored(_labelled(docs).filter("doc_id is not null").select("doc_id", "sig", (F.col("component_id") != F.col("doc_id")).alias("gone")), "join-gone")
    ids = rows.groupBy("doc_id").agg(F.bool_or("gone").alias("some"), F.bool_and("gone").alias("every"))
    partly = ids.filter("some and not every").select("doc_id")
    # docs' own columns stay in a struct, so that none of them clashes with what is joined.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), pick(docs, "doc_id", "long").alias("doc_id"))
    kept = own.join(ids.filter("every").select("doc_id"), "doc_id", "left_anti")
    if partly.isEmpty():
        return kept.select("doc.*")
    partly = stored(partly, "join-partly")
    inside = F.col("doc.text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    told = kept.join(partly, "doc_id", "left_semi").withColumn("sig", _signature_of(inside))
    gone = rows.filter("gone").select("doc_id", "sig").distinct()
    told = told.join(gone, ["doc_id", "sig"], "left_anti")
    return kept.join(partly, "doc_id", "left_anti").select("doc.*").unionByName(told.select("doc.*"))
