"""Joins, set operations and aggregates in the shapes that the engine's stages need."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a dimension counts as small enough to be sent to every task.
SMALL_ROWS = 100_000
#: Tasks for each core where rows are dealt anew, so that none is a whole core's work.
SPREAD = 8


def small(dim: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """dim, marked for broadcast if it has been counted to be small."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def apart(table: DataFrame, rows: int | None = None) -> DataFrame:
    """table, marked to meet others by a shuffle if it has been counted to be large: a broadcast goes whole through the driver."""
    rows = SMALL_ROWS if rows is None else rows
    return table.hint("merge") if table.limit(rows + 1).count() > rows else table


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that costs much a row: rows are dealt anew only if df has fewer parts than there are cores, then into several for each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(SPREAD * cores) if df.rdd.getNumPartitions() < cores else df


def coalesced_left(left: DataFrame, paths: Sequence[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """left with `value` from the first path that has one.

    A path is (table of key and value, left column, key column); its keys are unique. Each
    path is an equi join of its own, so none turns into a nested loop.
    """
    names = []
    for i, (table, own, key) in enumerate(paths):
        name = f"_{value}_{i}"
        side = table.select(F.col(key).alias(f"_key_{i}"), F.col(value).alias(name))
        left = left.join(side, F.col(own) == F.col(f"_key_{i}"), "left").drop(f"_key_{i}")
        names.append(name)
    return left.withColumn(value, F.coalesce(*map(F.col, names))).drop(*names)


def matched_by_any(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_key: str, row: str) -> DataFrame:
    """Rows of left of which any key is in right: keys stacked, one semi join, back by row id."""
    stacked = reduce(lambda a, b: a.unionAll(b), [left.select(F.col(row), F.col(k).alias("_key")) for k in left_keys])
    hits = stacked.filter("_key is not null").join(right.select(F.col(right_key).alias("_key")).distinct(), "_key", "left_semi").select(row).distinct()
    return left.join(hits, row, "left_semi")


def seen_flag(left: DataFrame, history: DataFrame, key: str, name: str = "seen") -> DataFrame:
    marks = history.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_mark", F.lit(True))
    return left.join(marks, key, "left").withColumn(name, F.coalesce("_mark", F.lit(False))).drop("_mark")


def interval_match(left: DataFrame, right: DataFrame, key: str, at: str, days: int, residual: Column | None = None, width: int | None = None) -> DataFrame:
    """Pairs of one key whose times lie within so many days: `l` and `r` are the sides' structs.

    Time is part of the join key: the right side is put in its bucket and the left one in its
    own and both neighbours, so a key with many rows is spread over its days.
    """
    seconds = (width or days) * 86400
    bucket = F.floor(F.unix_timestamp(at) / seconds)
    l = left.select(F.col(key).alias("_k"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"), F.struct("*").alias("l"))  # noqa: E741
    r = right.select(F.col(key).alias("_k"), bucket.alias("_b"), F.struct("*").alias("r"))
    near = F.abs(F.unix_timestamp(f"l.{at}") - F.unix_timestamp(f"r.{at}")) <= days * 86400
    out = l.join(r, ["_k", "_b"]).filter(near)
    return (out.filter(residual) if residual is not None else out).select("l", "r")


def priority_lookup(keys: DataFrame, key: str, sources: Sequence[DataFrame], value: str, at: str) -> DataFrame:
    """For each key the value of the first source that has it, the newest there.

    The best of each source is found before sources meet, by combining maxima.
    """
    best = [s.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.lit(-i).alias("p"), F.col(at).alias("a"), F.col(value).alias("v"))).alias("_b")) for i, s in enumerate(sources)]
    all_ = reduce(lambda a, b: a.unionByName(b), best).groupBy(key).agg(F.max("_b").alias("_b"))
    return keys.join(all_, key, "left").select(*keys.columns, F.col("_b.v").alias(value), (-F.col("_b.p")).alias("source_rank"))


def unambiguous(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Largest value of each key that belongs to a single group."""
    return df.groupBy(key).agg(F.min(group).alias("_a"), F.max(group).alias("_b"), F.max(value).alias(value)).filter("_a = _b").select(key, value)


def zero_filled(df: DataFrame, column: str, listed: Sequence[str]) -> DataFrame:
    """Counts of a fixed list of values, also of those that don't occur."""
    dim = df.sparkSession.createDataFrame([(x,) for x in listed], f"{column} string")
    return dim.join(df.filter(F.col(column).isin(*listed)).groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def aliases_in(items: DataFrame, item_id: str, fields: Sequence[str], aliases: DataFrame) -> DataFrame:
    """item_id, name, alias, field: aliases (name, alias: lower-case words) that occur in a field as words.

    A field's distinct runs of as many words as aliases have meet the aliases by equality; the
    text itself stays where it is read, and the catalogue may grow without a nested loop.
    """
    spelt = aliases.select("name", "alias", F.size(F.split("alias", " ")).alias("_n"))
    sizes = sorted(r["_n"] for r in spelt.select("_n").distinct().collect())
    normal = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))

    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    found = None
    for f in fields:
        words = items.select(F.col(item_id), F.lit(f).alias("field"), F.split(normal(F.col(f)), " ").alias("_w"))
        one = words.select(item_id, "field", F.explode(F.array_distinct(F.flatten(F.array(*[runs(F.col("_w"), n) for n in sizes or [1]])))).alias("alias"))
        found = one if found is None else found.unionByName(one)
    return found.filter("alias <> ''").join(spelt.drop("_n"), "alias").select(item_id, "name", "alias", "field").distinct()


def round_robin(df: DataFrame, source: str, source_order: str, position: str, key: str, limit: int = 20) -> DataFrame:
    """Rows taken in turn from each source, first sight of a key only, with their place.

    A round that meets repeats only is the last one, so each earlier round adds a row and no
    more than `limit` rounds count: of a source only that many rows are ever ranked or moved.
    """
    turn = F.row_number().over(Window.partitionBy(source).orderBy(position))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_turn", source_order))
    rounds = df.withColumn("_turn", turn).filter(F.col("_turn") <= limit)
    taken = rounds.withColumn("_sight", first).filter("_sight = 1").orderBy("_turn", source_order).limit(limit)
    # Rounds are numbered without gaps up to the one that adds nothing.
    taken = taken.withColumn("place", F.row_number().over(Window.orderBy("_turn", source_order))).withColumn("_round", F.dense_rank().over(Window.orderBy("_turn")))
    return taken.filter("_round = _turn").drop("_turn", "_sight", "_round")


def newest_before(items: DataFrame, history: DataFrame, key: str, at: str, tie: str, days: int = 30) -> DataFrame:
    """items with `newest`: a struct of the columns of history's newest row of the same key that isn't later; null without any.

    Of rows of one time the largest `tie` counts. Rows meet within a key's span of days; what came
    before a span is told by the newest row of each earlier one, so no key is ordered whole in one
    task and no row moves more than once. Rows with a null key or time meet nothing.
    """
    from pyspark.sql import Window

    span = lambda df: F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (days * 86400))
    told = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in history.columns]).alias("row"))
    past = history.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), span(history).alias("_span"), F.col(at).alias("_at"), told.alias("_told"))
    mine = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("_item"), F.col(key).alias("_key"), span(items).alias("_span"), F.col(at).alias("_at"))
    met = mine.filter("_key is not null and _at is not null")
    both = met.withColumn("_told", F.lit(None).cast(past.schema["_told"].dataType)).unionByName(past.withColumn("_item", F.lit(None).cast(mine.schema["_item"].dataType)))
    upto = Window.partitionBy("_key", "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_in", F.max("_told").over(upto)).filter("_item is not null")
    spans = past.groupBy("_key", "_span").agg(F.max("_told").alias("_last")).unionByName(met.select("_key", "_span", F.lit(None).cast(past.schema["_told"].dataType).alias("_last")).distinct()).groupBy("_key", "_span").agg(F.max("_last").alias("_last"))
    earlier = spans.withColumn("_before", F.max("_last").over(Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    out = inside.join(earlier, ["_key", "_span"], "left").select("_item.*", F.coalesce("_in", "_before")["row"].alias("newest"))
    alone = mine.filter("_key is null or _at is null").select("_item.*", F.lit(None).cast(out.schema["newest"].dataType).alias("newest"))
    return out.unionByName(alone)
