"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import pick, stored, word_count

#: Cells of a source: size bands (sixteen to a doubling) times hash slices.
SLICES = 64
#: Orders of a source's cells that are tried, and offsets with each.
ORDERS, OFFSETS = 8, 8
#: No document is taken more often than this.
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources by code point, null last, get weights in turn and share the sum of all sizes. A
    target stops at `most` times its source's size; the excess goes to the others by weight
    until none is above. With sources ordered by most * size / weight, that level is reached
    at the first source from which the rest of the total per weight no longer exceeds it: one
    prefix sum gives every step of the redistribution at once.
    The table has one row per source, whatever the number of documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.col("weight_left"))
    # Capped sources form a prefix of this order; the level of the first one that isn't holds for the rest.
    free = F.col("cap") / F.col("w") > F.col("level")
    rows = rows.withColumn("free_level", F.first(F.when(free, F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("w") * F.col("free_level"), F.col("cap"))
    return rows.select(*sizes.columns, F.least(target, F.col("cap")).alias("target"))


def _key(source: Column) -> Column:
    """A null-free join key; the null source differs from the empty one."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _band(size: Column) -> Column:
    return F.floor(16 * F.log2(size.cast("double") + 1)).cast("int")


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (and the carried columns) of every row.

    Every document of a source is expected target / source_size times. The documents of a
    source are put in order of size band, hash slice, size and hash; expected copies are
    prefix-summed in that order, one random offset per source is added, and a document is
    taken once for each integer that its interval crosses. With cells in order of size, what a
    source gives stays within about one document of its target. As a document may be a tenth of
    it, ORDERS orders of cells are tried with OFFSETS offsets each, a random one and its shifts,
    and those are taken with which the source's words come nearest to its target.

    No source is ordered in one task: cells (source, band, slice) are counted, the counts are
    prefix-summed over a source's bounded number of cells, and rows are ranked in their cell.
    Documents are listed once in the shared folder, so offset, order and thus reruns agree.
    Sizes are words; null texts and sources without words have size 0 and are never taken.
    Null sources are a source of their own. Repeated rows are ranked one by one.
    """
    text = pick(docs, "text", "string")
    rows = docs.select(
        pick(docs, "doc_id", "long").alias("doc_id"), pick(docs, "source", "string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(pick(docs, "doc_id", "long"), F.lit(seed)).alias("h"), _key(pick(docs, "source", "string")).alias("key"), *[F.col(f"`{c}`").alias(f"own_{c}") for c in carry],
    )
    rows = stored(rows.withColumns({"band": _band(F.col("size")), "slice": F.pmod("h", F.lit(SLICES)).cast("int")}), "mix-rows")
    cells = stored(rows.groupBy("key", "band", "slice").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights)
    offset = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The first order of a source's cells is that of sizes, the others are random ones.
    orders = [[F.lit(0), F.col("band"), F.col("slice")]] + [[F.xxhash64("key", "band", "slice", F.lit(seed + 2 + k)), F.col("band"), F.col("slice")] for k in range(1, ORDERS)]
    before = [F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for o in orders]
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cells = cells.withColumns({f"first{k}": c for k, c in enumerate(before)}).join(targets.drop("source"), "key").withColumn("each", each)
    cells = stored(cells.select("key", "band", "slice", *[f"first{k}" for k in range(ORDERS)], "source_size", "target", "each", offset.alias("u")), "mix-places")
    in_cell = Window.partitionBy("key", "band", "slice").orderBy("size", "h", F.col("doc_id").isNull(), "doc_id")

    def copies(i: Column, u: Column) -> Column:
        """Integer boundaries that the interval of a source's i-th row crosses."""
        n = F.floor(i * F.col("each") + u) - F.floor((i - 1) * F.col("each") + u)
        return F.when(F.col("size") > 0, F.least(n, F.lit(MOST))).otherwise(0).cast("long")

    # What each of some orders and offsets (a random one and its shifts by equal steps) would take is told exactly.
    tries = [(k, F.pmod(F.col("u") + F.lit(g / OFFSETS), F.lit(1.0))) for k in range(ORDERS) for g in range(OFFSETS)]
    ranked = rows.select("key", "band", "slice", "size", "h", "doc_id").withColumn("i", F.row_number().over(in_cell)).join(cells, ["key", "band", "slice"])
    told = ranked.groupBy("key").agg(F.first("target").alias("target"), F.first("u").alias("u"), *[F.sum(F.col("size") * copies(F.col(f"first{k}") + F.col("i"), u)).alias(f"t{j}") for j, (k, u) in enumerate(tries)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("gap"), F.lit(j).alias("j"), F.lit(k).alias("k"), u.alias("u")) for j, (k, u) in enumerate(tries)]))
    chosen = stored(told.select("key", nearest.alias("best")).select("key", "best.k", "best.u"), "mix-offsets")
    cells = cells.drop("u").join(chosen, "key").withColumn("first", F.array(*[F.col(f"first{k}") for k in range(ORDERS)])[F.col("k")])
    both = rows.withColumn("i", F.row_number().over(in_cell)).join(cells.select("key", "band", "slice", "first", "source_size", "target", "each", "u"), ["key", "band", "slice"])
    taken = copies(F.col("first") + F.col("i"), F.col("u"))
    return both.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"), *[F.col(f"`own_{c}`") for c in carry])


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs' rows and columns as the mix takes them: each row as often as it is taken."""
    mixed = mix_sources(docs, seed, carry=tuple(docs.columns)).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`own_{c}`").alias(c) for c in docs.columns])
