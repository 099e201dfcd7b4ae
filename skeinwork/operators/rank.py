"""Representatives, first sightings, quotas and ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.relational import small
from skeinwork.operators.shared import dropped, own_folder, stored


def best_of(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in an order that ends in a unique column.

    Ranks are limited in the map tasks already (the rank filter is pushed below the shuffle).
    """
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def quota(df: DataFrame, bucket: str, preferred: Sequence[str], order: Sequence[Column], each: int = 1) -> DataFrame:
    """The first rows of each preferred bucket."""
    return df.filter(F.col(bucket).isin(*preferred)).withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("_r") <= each).drop("_r")


def first_seen(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """First row of each key; rows without a key all stay."""
    keyed = df.withColumn("_key", key)
    with_key = keyed.filter("_key is not null").withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_r = 1").drop("_r", "_key")
    return with_key.unionByName(keyed.filter("_key is null").drop("_key"))


def fold(df: DataFrame, group: Sequence[str], schema: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """An ordered fold of each group; for choices that no total order expresses.

    A group is a fold's own bound: a customer's orders, a component's rows.
    """
    return df.groupBy(*group).applyInPandas(step, schema)


def tie_window_choice(rows: list[dict], window: float = 5) -> dict:
    """Representative of rows in arrival order: a score beyond the window wins, inside it the
    evidence, then score, then the later date, then the smaller url. Not transitive."""

    def better(a: dict, b: dict) -> bool:
        gap = a["score"] - b["score"]
        if abs(gap) > window:
            return gap > 0
        if a["evidence"] != b["evidence"]:
            return a["evidence"] > b["evidence"]
        if gap:
            return gap > 0
        if a["at"] != b["at"]:
            return a["at"] > b["at"]
        return a["url"] < b["url"]

    chosen = rows[0]
    for row in rows[1:]:
        if better(row, chosen):
            chosen = row
    return chosen


def tie_window_best(rows: Column, window: float = 5) -> Column:
    """tie_window_choice() of an array of structs in arrival order (score, evidence, at, url and what else they have), in the JVM."""

    def better(a: Column, b: Column) -> Column:
        gap = a["score"] - b["score"]
        return F.when(F.abs(gap) > window, gap > 0).when(a["evidence"] != b["evidence"], a["evidence"]).when(gap != 0, gap > 0).when(a["at"] != b["at"], a["at"] > b["at"]).otherwise(a["url"] < b["url"])

    return F.aggregate(rows, rows[0], lambda chosen, row: F.when(better(row, chosen), row).otherwise(chosen))


#: What more than one of so many rows share is hot; so there are never more hot keys than this.
HOT = 4096


def _met(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """rows joined with keys (k, once each, and n, how many rows have it): hot keys by a broadcast of at most HOT of them, all others by a shuffle."""
    hot, cold = keys.filter(F.col("n") * HOT > total), keys.filter(F.col("n") * HOT <= total)
    return rows.join(F.broadcast(hot), "k").unionByName(rows.join(F.broadcast(hot.select("k")), "k", "left_anti").join(cold.hint("merge"), "k"))


def _told(keys: Sequence[Column], within: Sequence[Column]) -> Column:
    """A row's keys, none of them null or empty; those of different columns, or of rows that differ in `within`, never meet."""
    told = [F.struct(F.lit(i).alias("i"), F.struct(*[w.alias(f"w{j}") for j, w in enumerate(within)], F.lit(0).alias("_")).alias("w"), k.cast("string").alias("v")) for i, k in enumerate(keys)]
    return F.filter(F.array(*told), lambda k: k["v"] != "")


def first_seen_any(df: DataFrame, row: str, order: Sequence[Column], keys: Sequence[Column], within: Sequence[Column] = ()) -> DataFrame:
    """Rows, in an order, of which no key has been seen on a row that stayed; null and empty keys don't count.

    row: a column that tells rows apart; it ends the order. Keys of different columns never meet, nor
    do those of rows that differ in `within`. What a fold over all rows in order gives is found in
    rounds: of the rows that aren't decided, those that come first for each of their keys stay,
    and all others with one of these keys go. The first undecided row always stays, so the rounds
    come to an end; in orders that aren't made for it, a few settle all. A key that many rows
    share costs each task one row where it is counted, and is broadcast where its rows meet it.
    """
    spark = df.sparkSession
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row).alias("row"))
    keyed = df.select(F.col(row).alias("row"), place.alias("place"), F.explode_outer(_told(keys, within)).alias("k"))
    keyed = stored(keyed)
    without = keyed.filter("k is null").select("row")
    open_, kept = stored(keyed.filter("k is not null")), own_folder(spark, "kept")
    without.write.parquet(kept)
    total = open_.count()
    while total:
        least = open_.groupBy("k").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        stays = _met(open_, least, total).groupBy("row").agg(F.bool_and(F.col("place") == F.col("first")).alias("stays")).filter("stays").select("row")
        stays = stored(stays)
        stays.write.mode("append").parquet(kept)
        taken = open_.join(stays, "row", "left_semi").select("k").distinct().join(open_.groupBy("k").agg(F.count("*").alias("n")), "k")
        gone = _met(open_.select("row", "k"), taken, total).select("row").distinct()
        rest = stored(open_.join(gone, "row", "left_anti"))
        dropped(open_, stays)
        open_, total = rest, rest.count()
    return df.join(spark.read.schema(without.schema).parquet(kept).withColumnRenamed("row", row), row, "left_semi")


#: A group is asked for so many times the rows that it has to give, and for so many times more each time it hasn't enough that stay.
MORE, FURTHER = 2, 8
#: So often rows are looked up that may make others a repeat; a group that needs more is read whole.
LOOKS = 3


def first_few_seen_any(df: DataFrame, best: str, ties: Sequence[str], keys: Sequence[Column], within: Sequence[str], whole: int, part: str | None = None) -> DataFrame:
    """Of the rows that first_seen_any() leaves of each group (`within`) the first `whole`, and the first of each `part` that isn't null.

    The order is from the largest `best` down, then by `ties`, whose last column tells rows apart.
    Whether a row stays follows from the rows before it that share a key with it, and from those
    that these share keys with: beside the first rows of groups and parts only they are looked up, and no
    others move. Groups of which too few rows stay are asked for more, until they have enough or end.
    """
    group, order, row = F.struct(*within).alias("_group"), [F.desc(best), *map(F.col, ties)], ties[-1]
    rank_of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    told, columns = _told(keys, [F.col(w) for w in within]), df.columns
    ask, out = MORE, None
    while True:
        # A group's first rows are among the first of its parts: all of df is ranked once.
        n, heads = ask * whole, 2 * ask
        ranked = stored(df.withColumn("_p", rank_of(*within, *([part] if part else []))).filter(F.col("_p") <= n))
        first, head = F.col("_w") <= n, F.lit(False) if part is None else F.col(part).isNotNull() & (F.col("_p") <= heads)
        near = stored(ranked.withColumn("_w", rank_of(*within)).filter(first | head))
        # No row comes before a group's first ones that isn't one of them.
        all_, asked = near.select(columns), near.filter(~first)
        for _ in range(LOOKS if part else 0):
            wanted = stored(asked.select(F.col(best).alias("_best"), F.explode(told).alias("_k")).groupBy("_k").agg(F.min("_best").alias("_upto")))
            sharers = df.select(*columns, F.explode(told).alias("_k")).join(small(wanted), "_k").filter(F.col(best) >= F.col("_upto")).select(columns)
            asked = stored(sharers.dropDuplicates([row]).join(all_.select(row), row, "left_anti").select(columns))
            if asked.isEmpty():
                break
            all_ = all_.unionByName(asked)
        else:
            if part:
                open_ = small(asked.select(group).distinct())
                all_ = all_.unionByName(df.withColumn("_group", group).join(open_, "_group", "left_semi").select(columns).join(all_.select(row), row, "left_anti").select(columns))
        placed = stored(all_.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
        stay = first_seen_any(placed, "_place", [], keys, [F.col(w) for w in within]).select(row, F.lit(True).alias("_stays"))
        decided = stored(near.join(stay, row, "left").withColumn("_stays", F.coalesce("_stays", F.lit(False))))
        lacks = lambda by, of, asked_, n: decided.filter(of).groupBy(*by).agg(F.count("*").alias("_n"), F.count_if("_stays").alias("_has")).filter((F.col("_n") >= asked_) & (F.col("_has") < n)).select(group)
        short = lacks(within, first, n, whole)
        if part:
            short = short.unionByName(lacks([*within, part], head, heads, 1))
        short = stored(short.distinct())
        stays = decided.filter("_stays").withColumn("_w", F.when(first, rank_of(*within, first))).withColumn("_p", F.when(head, rank_of(*within, part or within[0], head)))
        got = stays.filter((F.col("_w") <= whole) | (F.col("_p") <= 1)).withColumn("_group", group).join(short, "_group", "left_anti").select(columns)
        out = got if out is None else out.unionByName(got)
        if short.isEmpty():
            return stored(out)
        df = stored(df.withColumn("_group", group).join(small(short), "_group", "left_semi").select(columns))
        ask *= FURTHER


def first_unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the nodes that have no edge to an earlier one that stayed, each probed in order against those accepted so far.

    nodes: id, place (their order; ties by id). edges: a, b, in either direction. Rounds as in
    first_seen_any(): nodes without an undecided earlier neighbour stay, their neighbours go.
    """
    spark = nodes.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct()
    at = nodes.select("id", F.struct("place", "id").alias("at"))
    open_ = stored(both.join(at.toDF("a", "x"), "a").join(at.toDF("b", "y"), "b"))
    lonely = nodes.select("id").join(open_.select(F.col("a").alias("id")), "id", "left_anti")
    left, kept = stored(open_.select(F.col("a").alias("id")).distinct()), own_folder(spark, "kept")
    lonely.write.parquet(kept)
    while not left.isEmpty():
        stays = stored(left.join(open_.filter("y < x").select(F.col("a").alias("id")), "id", "left_anti"))
        stays.write.mode("append").parquet(kept)
        gone = stored(open_.join(stays.toDF("b"), "b", "left_semi").select(F.col("a").alias("id")).unionByName(stays).distinct())
        more = stored(left.join(gone, "id", "left_anti"))
        rest = stored(open_.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti"))
        dropped(left, open_, stays, gone)
        left, open_ = more, rest
    return spark.read.schema(lonely.schema).parquet(kept)
