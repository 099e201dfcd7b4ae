"""Product codes of vectors: integer codebooks, and assignment by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import pick, stored, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this don't fit: up to it a distance over 4096 dimensions is exact in 64 bits.
LIMIT = 4096
#: Rows searched at once; a part's distances to all entries are held for them.
ROWS = 1 << 13
#: A label that more than one row of so many has is hot; so there are never more hot labels than this.
HOT = 4096


def finite(embedding: Column) -> Column:
    """Whether an embedding is there, has components and each of them is a finite number."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & (F.size(embedding) > 0), F.lit(False))


def integers(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vector (longs, each the floor of SCALE times a component) of the rows whose embedding is finite."""
    v = F.col(f"`{embedding_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(pick(vectors, id_col, "long").alias("vec_id"), label.alias("label"), v.alias("v")).filter(finite(F.col("v")))
    whole = F.transform("v", lambda x: F.when(F.abs(x) <= LIMIT, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component lies beyond {LIMIT}")).cast("long")))
    return rows.select("vec_id", "label", whole.alias("vector"))


class Codebooks:
    """Entries of each part; a part may have a dimension less than another only through padding by zeros."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries  # parts x entries x dimensions of a part
        # Dimensions in which the entries differ most come first: they part near from far the soonest.
        self.order = np.argsort(-entries.astype(float).var(axis=1), axis=1, kind="stable")

    def nearest(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry of part p nearest to each row of x, ties to the lower index.

        Dimensions are taken in descending variance of the codebook. After the first, a row
        completes the entry that leads; pairs of a row and another entry go on dimension by
        dimension and are dropped once their sum exceeds the row's complete distance. What is
        as far as that one stays, so ties are decided by index alone.
        """
        c, order = self.entries[p], self.order[p]
        first = x[:, order[0], None] - c[None, :, order[0]]
        first *= first
        lead = first.argmin(axis=1)
        whole = x - c[lead]
        best = np.einsum("ij,ij->i", whole, whole)
        live = first <= best[:, None]
        live[np.arange(len(x)), lead] = False
        row, entry = np.nonzero(live)
        sums = first[row, entry]
        for d in order[1:]:
            if not len(row):
                break
            gap = x[row, d] - c[entry, d]
            sums += gap * gap
            stay = sums <= best[row]
            row, entry, sums = row[stay], entry[stay], sums[stay]
        if len(row):
            # Pairs lie by row: of a row's complete distances the smallest counts, then the lower index.
            by = np.lexsort((entry, sums, row))
            row, entry, sums = row[by], entry[by], sums[by]
            head = np.ones(len(row), bool)
            head[1:] = row[1:] != row[:-1]
            row, entry, sums = row[head], entry[head], sums[head]
            better = (sums < best[row]) | ((sums == best[row]) & (entry < lead[row]))
            lead[row[better]], best[row[better]] = entry[better], sums[better]
        return lead, best

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def parts_of(column: pa.Array, dimensions: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, end row and rows x parts x dimensions of a part, some rows at a time."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)
    wide = -(-dimensions // PARTS)
    for i in range(0, len(column), ROWS):
        x = values[i : i + ROWS]
        x = np.pad(x, ((0, 0), (0, PARTS * wide - dimensions))).reshape(len(x), PARTS, wide)
        yield i, i + len(x), x


def _sums(books: Codebooks, dimensions: int):
    """Each task's sums and counts of the parts nearest to each entry: at most PARTS x ENTRIES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            for _, _, x in parts_of(batch.column(0), dimensions):
                for p in range(PARTS):
                    near, _ = books.nearest(x[:, p], p)
                    np.add.at(total[p], near, x[:, p])
                    count[p] += np.bincount(near, minlength=count.shape[1])
        part, entry = np.nonzero(count)
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def fit(rows: DataFrame, dimensions: int) -> Codebooks | None:
    """Codebooks of integers()'s rows of one length: they start as the smallest ids' parts; ROUNDS rounds move each entry to its parts' mean."""
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not start:
        return None
    first = np.array([r["vector"] for r in start], np.int64)
    wide = -(-dimensions // PARTS)
    books = Codebooks(np.pad(first, ((0, 0), (0, PARTS * wide - dimensions))).reshape(len(first), PARTS, wide).transpose(1, 0, 2).copy())
    for _ in range(ROUNDS):
        found = rows.select("vector").mapInArrow(tidy(_sums(books, dimensions)), "part int, entry int, n long, total array<long>")
        found = found.select("part", "entry", "n", F.posexplode("total").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        entries = books.entries.copy()
        for r in found.collect():  # at most one row for each component of the codebooks
            entries[r["part"], r["entry"], r["i"]] = r["x"] // r["n"]
        books = Codebooks(entries)
    return books


def _codes(books: Codebooks, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for i, j, x in parts_of(batch.column(2), dimensions):
                for p in range(PARTS):
                    near, distance = books.nearest(x[:, p], p)
                    code[i:j, p] = near
                    error[i:j] += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the errors' sum over each row's label. Sums are combined before they move; rows of
    a hot label meet its sum by a broadcast of at most HOT rows, all others by a join."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "code-labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sums.filter(F.col("n") * HOT > total).select(F.col("label").alias("of"), "label_error"))
    cold = sums.filter(F.col("n") * HOT <= total).select(F.col("label").alias("of"), "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    return coded.join(hot, same).drop("of").unionByName(coded.join(hot, same, "left_anti").join(cold.hint("merge"), same).drop("of"))


def compress(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row with a finite embedding.

    A vector of integers is cut into PARTS equal parts; each part's code is its nearest of the
    ENTRIES entries of that part's codebook, as two hex digits. Codebooks are fitted on all rows:
    a round is one pass, whose tasks send a row for each entry at most.

    Rows whose embedding is null or empty, or holds null or non-finite components, go. Rows of
    one id start codebooks in the order of their vectors, a null id comes last; fewer than
    ENTRIES rows make smaller codebooks; repeated rows repeat in the result. The length that
    counts is that of the first row in this order: a row of another length keeps a null code
    and a null error and moves no codebook. A length that PARTS doesn't divide is filled up
    with zeros. A component beyond LIMIT is an error, as sums would no longer be exact. Null
    labels are one label, as is a column that isn't there; other columns aren't read; an
    empty table gives no rows.
    """
    rows = stored(integers(vectors, id_col, embedding_col, label_col), "code-vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    dimensions = first[0] if first else 1
    alike = rows.filter(F.size("vector") == dimensions)
    books = fit(alike, dimensions)
    kinds = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if books is None:
        coded, digest = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), ""
    else:
        coded, digest = alike.mapInArrow(tidy(_codes(books, dimensions)), kinds), books.digest()
    odd = rows.filter(F.size("vector") != dimensions).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stored(coded.unionByName(odd), "codes")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest))
