"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import pick, stored

BITS = 64
#: Distinct codes of an index block, and distinct query codes of a query block.
INDEX_BLOCK, QUERY_BLOCK = 1 << 18, 1 << 10


def sign_code(embedding: Column) -> Column:
    """A bit per component, set where it is above 0 (a null or NaN component counts as not), as a long.

    An embedding of more components than a code has bits is an error.
    """
    bit = lambda x: F.when((x > 0) & ~F.isnan(x), F.lit(1)).otherwise(F.lit(0)).cast("long")
    code = F.aggregate(embedding, F.lit(0).cast("long"), lambda code, x: F.shiftleft(code, 1).bitwiseOR(bit(x)))
    return F.when(F.size(embedding) > BITS, F.raise_error(F.lit(f"a code has {BITS} bits")).cast("long")).otherwise(code)


class MultiIndex:
    """Codes cut into segments; in each, the codes sorted by segment value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.view(np.uint64)
        self.width = int(np.clip(round(np.log2(max(2, len(codes)))), 4, 16))
        self.cuts = [(a, min(self.width, BITS - a)) for a in range(0, BITS, self.width)]
        self.tables = []
        for a, w in self.cuts:
            value = (self.codes >> np.uint64(a)) & np.uint64((1 << w) - 1)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << w) + 1, dtype=np.uint64))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def _masks(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def search(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes no further than the k-th nearest.

        Radius r is searched segment by segment. Once segments 0..j have been searched to
        radius r and the rest to r - 1, any code not yet met differs by more than that in each
        segment, so all codes within m * r + j are known; the search ends when the k-th
        verified distance is no larger.
        """
        n, m = len(self.codes), len(self.cuts)
        q = np.uint64(code & ((1 << 64) - 1))
        seen = np.zeros(n, bool)
        places, distances = [], []
        counts = np.zeros(BITS + 1, np.int64)
        for r in range(self.width + 1):
            for j, (a, w) in enumerate(self.cuts):
                if r <= w:
                    order, starts = self.tables[j]
                    value = int((q >> np.uint64(a)) & np.uint64((1 << w) - 1)) ^ self._masks(w, r)
                    lo, size = starts[value], starts[value + 1] - starts[value]
                    lo, size = lo[size > 0], size[size > 0]
                    if len(lo):
                        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                        new = order[at]
                        new = new[~seen[new]]
                        if len(new):
                            seen[new] = True
                            d = np.bitwise_count(self.codes[new] ^ q)
                            places.append(new)
                            distances.append(d)
                            counts += np.bincount(d, minlength=BITS + 1)
                covered = m * r + j
                within = counts[: min(covered, BITS) + 1].sum()
                if within >= min(k, n):
                    p, d = np.concatenate(places), np.concatenate(distances)
                    last = int(np.searchsorted(np.cumsum(counts), min(k, n)))
                    return p[d <= last], d[d <= last]
        raise AssertionError("every code lies within the last radius")


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k rows nearest to each query by Hamming
    distance of sign codes, ties by id.

    Queries are all rows whose id is divisible by `every`; all rows are searched, the query's
    own among them. Rows of one code are searched once: a distinct code keeps its row count's
    k smallest ids, enough for any answer, so a vector that a third of all rows share costs no
    more than another. Distinct codes are dealt into index blocks by hash, distinct query codes
    into query blocks; a task holds one of each and answers by multi-index hashing, and the
    blocks' answers (k a query) are merged. A null embedding or id has no code: such rows are
    neither found nor asked for. Repeated ids are found once each time they occur. Fewer than
    k rows give fewer answers, an empty table none; other columns aren't read.
    """
    rows = vectors.select(pick(vectors, id_col, "long").alias("id"), sign_code(F.col(f"`{embedding_col}`").cast("array<double>")).alias("code")).dropna()
    rows = stored(rows, "codes")
    # The k smallest ids of a code: by salt first, so no task gets all rows of a common code.
    place = F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("i", place).filter(F.col("i") <= k)
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = few.withColumn("i", place).filter(F.col("i") <= k)
    classes = stored(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "code-classes")
    blocks = max(1, -(-classes.count() // INDEX_BLOCK))
    asked = rows.filter(F.col("id") % every == 0)
    queries = stored(asked.select("code").distinct(), "query-codes")
    sets = max(1, -(-queries.count() // QUERY_BLOCK))
    index = classes.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"), "code", "ids")
    probes = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("code"), F.lit(sets)).cast("int").alias("set"), "code")

    def answer(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(own) and len(others):
            found = MultiIndex(others["code"].to_numpy(np.int64))
            ids = others["ids"].to_numpy()
            for q in own["code"].to_numpy(np.int64):
                places, distances = found.search(int(q), k)
                near = sorted((int(d), int(i)) for p, d in zip(places, distances) for i in ids[p])[:k]
                out += [(int(q), d, i) for d, i in near]
        return pd.DataFrame(out, columns=["code", "distance", "id"]).astype({"code": "int64", "distance": "int32", "id": "int64"})

    near = probes.groupBy("block", "set").cogroup(index.groupBy("block", "set")).applyInPandas(answer, "code long, distance int, id long")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.join(best.withColumnRenamed("id", "neighbour_id"), "code").select(F.col("id").alias("query_id"), "rank", "neighbour_id", "distance")
