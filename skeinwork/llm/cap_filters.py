"""Near copies among vectors by spherical-cap filters: structured random product codes, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.code_compression import finite
from skeinwork.llm.common import pick, stored, tidy
from skeinwork.llm.components import components

COSINE = 0.9
#: Filters that a vector passes and other vectors that pass one with it, both on average over unrelated vectors.
PASSES, LOAD = 48, 0.25
#: Filters that each vector passes at least.
FEWEST = 16
#: Caps are no narrower than this: two vectors whose cosine is COSINE must be able to meet in one.
NARROWEST = 0.75
#: Directions of a block at most (this bounds what is broadcast), and bits of the fixed-point numbers that decode alike everywhere.
DIRECTIONS, BITS = 4096, 15
#: Members of a filter that one task compares with each other; larger filters are cut into parts, each pair of which is a task.
PART = 1024
#: Rows decoded or compared at once.
ROWS = 1 << 10
#: What more than one of so many rows share is hot; so there are never more hot keys than this.
HOT = 4096


def cap_share(dimensions: int, cosines: np.ndarray) -> np.ndarray:
    """Share of the sphere whose cosine to a direction is at least each of cosines."""
    angle = np.linspace(0, np.pi, 1 << 14)
    area = np.cumsum(np.sin(angle) ** (max(dimensions, 2) - 2))
    return np.interp(np.arccos(cosines), angle, area / area[-1])


@dataclass
class Filters:
    """Directions that are sums of one direction from each block of a rotated space."""

    rotation: np.ndarray
    blocks: list[np.ndarray]
    least: int

    @staticmethod
    def build(dimensions: int, n: int, passes: float = PASSES, seed: int = 20240531) -> Filters:
        """Filters for n vectors: the more there are, the narrower the caps and the more directions, so that a
        filter's members don't grow with n. All numbers are whole ones: products of them are exact in doubles,
        so a vector passes the same filters wherever and beside whatever it is decoded."""
        cosines = np.linspace(NARROWEST, 0, 1 << 12)
        share = cap_share(dimensions, cosines)
        at = min(int(np.searchsorted(share, min(1e-3, LOAD / max(n, 1)))), len(share) - 1)
        wanted = passes / share[at]
        m = 1
        while wanted ** (1 / m) > DIRECTIONS and m < dimensions:
            m += 1
        each = int(min(DIRECTIONS, np.ceil(wanted ** (1 / m))))
        random = np.random.default_rng([seed, dimensions])
        rotation = np.linalg.qr(random.standard_normal((dimensions, dimensions)))[0]
        blocks = []
        for axes in np.array_split(np.arange(dimensions), m):
            c = random.standard_normal((len(axes), each))
            blocks.append(np.rint(c / np.linalg.norm(c, axis=0) / np.sqrt(m) * ((1 << BITS) - 1)).astype(np.int16))
        return Filters(np.rint(rotation * (1 << BITS)).astype(np.int32), blocks, int(np.floor(cosines[at] * (1 << 2 * BITS))))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every filter that each row of unit passes, in ascending order.

        A row that passes fewer than FEWEST lies between the directions: it is decoded again
        with wider caps, step by step, until it passes so many (or the caps are half spheres).
        """
        x = np.rint(unit * (1 << BITS)) @ self.rotation.astype(float)
        x = np.rint(x / (1 << BITS))
        products, a = [], 0
        for c in self.blocks:
            products.append((x[:, a : a + len(c)] @ c.astype(float)).astype(np.int64))
            a += len(c)
        rows, numbers, left, least = [], [], np.arange(len(x)), self.least
        while len(left):
            row, number = self._passed([p[left] for p in products] if len(left) < len(x) else products, least)
            enough = np.bincount(row, minlength=len(left)) >= (FEWEST if least > 0 else 0)
            rows.append(left[row[enough[row]]])
            numbers.append(number[enough[row]])
            left, least = left[~enough], max(least * 15 // 16, 0) if least > 64 else 0
        row, number = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(numbers or [np.zeros(0, np.int64)])
        by = np.lexsort((number, row))
        return row[by], number[by]

    @staticmethod
    def _passed(products: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the sums of one product a block that reach `least`.

        Block by block, a row's partial sums are joined only by directions with which, and the
        best of all later blocks, they can still reach it: the work follows what is found.
        """
        n, each = products[0].shape
        best = [p.max(axis=1) for p in products]
        every = sum(best)
        rest = every
        row, number, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        span = 1 << 2 * BITS + 8  # wider than any sum
        for p, top in zip(products, best):
            rest = rest - top
            r, j = np.nonzero(p >= (least - every + top)[:, None])
            value = p[r, j] + r * span
            by = value.argsort(kind="stable")
            value, j, ends = value[by], j[by], np.cumsum(np.bincount(r, minlength=n))
            need = np.clip(least - total - rest[row], -span // 2, span // 2)
            first = np.searchsorted(value, need + row * span)
            many = np.maximum(ends[row] - first, 0)
            at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            row, number, total = np.repeat(row, many), np.repeat(number, many), np.repeat(total, many)
            number = number * each + j[at]
            total = total + value[at] - row * span
        return row, number


def unit_rows(column: pa.Array, dimensions: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions).astype(float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # else the squares of very small or large components are lost
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _passed(filters: dict[int, Filters]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(size):
                if int(d) not in filters:
                    continue
                own = np.flatnonzero(size == d)
                for i in range(0, len(own), ROWS):
                    at = own[i : i + ROWS]
                    row, number = filters[int(d)].decode(unit_rows(batch.column(2).take(pa.array(at)), int(d)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(number), pa.array(c[at][row])], ["d", "filter", "c"])

    return run


def _earlier(filters: Filters, unit: np.ndarray, number: int) -> np.ndarray:
    """Which pairs of rows pass a filter of a smaller number together."""
    row, passed = filters.decode(unit)
    before = passed < number
    row, passed = row[before], passed[before]
    passed, at, times = np.unique(passed, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    row, at = row[times[at] > 1], shared[at[times[at] > 1]]
    met = np.zeros((len(unit), len(unit)), bool)
    for i in range(0, int(shared[-1]) + 1 if len(shared) else 0, ROWS):
        these = (at >= i) & (at < i + ROWS)
        member = np.zeros((len(unit), ROWS), np.float32)
        member[row[these], at[these] - i] = 1
        met |= member @ member.T > 0
    return met


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _verified(filters: dict[int, Filters], least: float):
    """Links of each filter's members: a class, how many rows its partners stand for, and a class that it hangs together with.

    A pair that several filters show counts in the first of them only, so links are counted
    without listing pairs: what a filter gives is at most a row for each member.
    """

    def compare(d: int, number: int, part: np.ndarray, c: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> list[tuple[int, int, int]]:
        linked = unit @ unit.T >= least
        np.fill_diagonal(linked, False)
        if part[0] != part[-1]:  # two parts of one filter: the pairs between them
            linked &= part[:, None] != part[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return []
        linked = linked[np.ix_(some, some)] & ~_earlier(filters[d], unit[some], number)
        counts, root = linked @ copies[some], _roots(linked)
        return [(int(c[some[i]]), int(counts[i]), int(c[some[root[i]]])) for i in np.flatnonzero(counts)]

    def flush(rows: pa.Table) -> pa.RecordBatch:
        d, number, x, y, part, c, copies = (rows.column(k).to_numpy() for k in ("d", "filter", "x", "y", "part", "c", "copies"))
        v = rows.column("v").combine_chunks()
        heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (number[1:] != number[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        size = np.diff(np.concatenate([heads, [len(d)]]))
        out: list[tuple[int, int, int]] = []
        for dim in np.unique(d):
            own = d == dim
            place = np.cumsum(own) - 1
            unit = unit_rows(v.filter(pa.array(own)), int(dim))
            mine = own[heads]
            # Most filters have few members: those of one size are compared together, to see which have a link at all.
            for s in np.unique(size[mine]):
                begins = heads[mine & (size == s)]
                if s < 2:
                    continue
                for i in range(0, len(begins), max(1, ROWS * 16 // (s * s))):
                    some = begins[i : i + max(1, ROWS * 16 // (s * s))]
                    if s <= 32:
                        u = unit[place[some][:, None] + np.arange(s)]
                        near = (u @ u.transpose(0, 2, 1) >= least - 1e-9).sum(axis=(1, 2)) > s
                        some = some[near]
                    for b in some:
                        e = b + s
                        out += compare(int(dim), int(number[b]), part[b:e], c[b:e], copies[b:e], unit[place[b] : place[b] + s])
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["c", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * ROWS:
                continue
            rows = pa.Table.from_batches(held)
            key = [rows.column(k).to_numpy() for k in ("d", "filter", "x", "y")]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            if len(last):  # the last filter may go on in the next batch
                cut = int(last[-1]) + 1
                yield flush(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _by_share(rows: DataFrame, others: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """rows joined with others, which have each key once and the number n of its rows: keys that many share by a broadcast of at most HOT of them."""
    hot, cold = others.filter(F.col(n) * HOT > total), others.filter(F.col(n) * HOT <= total)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold.hint("merge"), key))


def near_links(classes: DataFrame, least: float = COSINE, passes: float = PASSES) -> DataFrame:
    """c, links, root of the classes (c, copies, d, v) that are linked; a class may have several rows."""
    spread = classes.groupBy("d").count().filter("count > 1").collect()  # lengths of vectors
    filters = {r["d"]: Filters.build(r["d"], r["count"], passes) for r in spread}
    passed = stored(classes.select("c", "d", "v").mapInArrow(tidy(_passed(filters)), "d int, filter long, c long"), "cap-passed")
    members = stored(passed.groupBy("d", "filter").agg(F.count("*").alias("members")).filter("members > 1"), "cap-members")
    total = passed.count()
    met = _by_share(passed, members, ["d", "filter"], "members", total).withColumn("cuts", F.ceil(F.col("members") / PART).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("c"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select("d", "filter", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "c")
    tasks = met.join(classes.select("c", "copies", "v").hint("merge"), "c").repartition("d", "filter", "x", "y").sortWithinPartitions("d", "filter", "x", "y", "part")
    tasks = tasks.select("d", "filter", "x", "y", "part", "c", "copies", "v")
    return stored(tasks.mapInArrow(tidy(_verified(filters, least)), "c long, links long, root long"), "cap-links")


def near_duplicates(vectors: DataFrame, least: float = COSINE, passes: float = PASSES, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links are pairs of rows whose vectors' cosine is at least `least`.

    1. Rows of one vector form a class, which stands for them from here on.
    2. Each class's vector is decoded to all filters whose cap it lies in. Filters that one
       class alone passes are dropped before any vector moves.
    3. Members of a filter meet in a task, which verifies their cosines in double precision.
       No pairs are listed: a filter tells each member's links and a member that it hangs
       together with, and a pair counts in the first filter that shows it. A filter of more
       than PART members is cut into parts, each pair of which is a task.
    A linked pair that shares no filter isn't found; the more passes, the fewer are lost. No
    pair below `least` is linked.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, as do rows with a null id (whose component and kept are null and false). Vectors
    of different lengths aren't linked. Rows that repeat an id count each by itself; equal
    vectors are linked. An empty table gives no rows; other columns aren't read.
    """
    e = F.col(f"`{embedding_col}`")
    if vectors.schema[embedding_col].dataType.simpleString() != "array<float>":
        e = e.cast("array<double>")
    rows = vectors.select(pick(vectors, id_col, "long").alias("vec_id"), e.alias("v"))
    good = finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    classes = rows.filter(good).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "rep", "copies", F.size("v").alias("d"), "v"), "cap-classes")
    links = near_links(classes, least, passes)
    joined = components(links.select(F.col("c").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()).withColumnRenamed("node", "c")
    own = classes.drop("v", "d").join(links.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(joined, "c", "left")
    own = stored(own.select("c", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "c").alias("label")), "cap-own")
    first = own.filter("label <> c or links > 0").groupBy("label").agg(F.min("rep").alias("first"))
    own = own.join(first, "label", "left").select("c", "rep", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    own = stored(own, "cap-found")
    found = own.filter("copies = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    repeated = own.filter("copies > 1").join(classes.select("c", "v"), "c").select("v", "copies", "n_links", "component_id")
    total = own.agg(F.sum("copies")).first()[0] or 0
    copies = _by_share(rows.filter(good), repeated, ["v"], "copies", total).select("vec_id", "n_links", "component_id")
    none = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(copies).unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
