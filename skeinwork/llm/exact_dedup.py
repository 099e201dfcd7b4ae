"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import pick, stored, without_blanks

#: Salts a group of copies is merged under before its salt winners meet.
SALTS = 64
#: A digest that more than one row of so many has is hot; so there are never more hot digests than this.
HOT = 4096


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best() -> Column:
    """Orders rows: most code points, then smallest doc_id (null last), then the row itself."""
    return F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))


def _salt() -> Column:
    """The salt of a row is that of the partition it lies in: copies of a partition stay together."""
    return F.pmod(F.spark_partition_id(), F.lit(SALTS))


def _combined(rows: DataFrame, key: list[str], **kept: Column) -> DataFrame:
    """One row per key with its size and what is `kept` of its winner: each partition merges its
    own copies (the partial aggregate), then salted groups merge, then the salt winners."""
    salted = rows.groupBy(*key, _salt().alias("salt")).agg(F.min(_best()).alias("best"), *[F.min_by(c, _best()).alias(k) for k, c in kept.items()], F.count("*").alias("size"))
    return salted.groupBy(*key).agg(F.min("best").alias("best"), *[F.min_by(k, "best").alias(k) for k in kept], F.sum("size").alias("size"))


def _repeated(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Digests that two rows or more have, and the hot ones among them, of which there are HOT at most."""
    counts = rows.groupBy("digest", _salt().alias("salt")).agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n"))
    counts = stored(counts, name)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    return counts.filter("n > 1").filter(~hot).select("digest"), counts.filter("n > 1").filter(hot).select("digest")


def duplicate_groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, digest (of the normalised text).

    Texts are equal when identical after the ASCII blanks are deleted; null counts as empty.
    Rows whose digest no other row has can't have a copy and need no content. All others are
    combined by digest and full content, in the partition, by salt and globally, so that two
    texts with one digest stay apart (digest is a parameter: tests pass a weak one).
    Rows of hot digests are told in the partition they are read in, by a broadcast of at most
    HOT digests: their copies merge there before any of them moves, and they find their group
    under salts. All other digests have too few rows to fill a task.
    Ties: the smallest doc_id stays, a null doc_id loses to any other, and of rows that repeat
    a doc_id with its text one stays. An empty table gives an empty result; other columns of
    docs are not read. A text is held once by the task that reads it, however long.
    """
    norm = without_blanks(F.col("text"))
    work = docs.select(pick(docs, "doc_id", "long").alias("doc_id"), pick(docs, "text", "string").alias("text"))
    work = work.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), norm.alias("norm")).select("*", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    work = stored(work, "exact-work")
    cold, hot = _repeated(work.select("digest"), "exact-counts")
    marked = F.broadcast(hot.withColumn("hot", F.lit(True)))

    merged = _combined(work.join(F.broadcast(hot), "digest"), ["digest", "norm"]).unionByName(_combined(work.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest", "left_semi"), ["digest", "norm"]))
    groups = stored(merged, "exact-groups")
    contents = groups.groupBy("digest").agg(F.count("*").alias("contents"))

    def salted(df: DataFrame) -> DataFrame:
        """Rows with the salt that they look for their group under."""
        return df.join(marked, "digest", "left").withColumn("salt", F.when(F.col("hot"), _salt()).otherwise(0)).drop("hot")

    def copied(df: DataFrame) -> DataFrame:
        """Rows under every salt that looks for them."""
        return df.join(marked, "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")

    alone = groups.drop("norm").join(contents.filter("contents = 1").select("digest"), "digest", "left_semi")
    light = salted(work.drop("norm"))
    clash = contents.filter("contents > 1").select("digest")
    found = light.join(copied(alone), ["digest", "salt"], "left")
    if not clash.isEmpty():
        # Different texts under one digest: their rows find their group by content.
        clash = copied(clash)
        found = light.join(clash, ["digest", "salt"], "left_anti").join(copied(alone), ["digest", "salt"], "left")
        met = salted(work).join(clash, ["digest", "salt"], "left_semi").join(copied(groups), ["digest", "salt", "norm"], "left").drop("norm")
        found = found.unionByName(met)
    single = F.col("best").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.c")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("best.d"))).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns; ties and nulls as in duplicate_groups.

    Rows of hot digests merge where they are read, and only winners move. All others move once,
    to learn whether their digest repeats; those of repeated digests are combined by content.
    A winner takes its row with it, so rows that share a doc_id are told apart and nothing is
    joined back. An empty table stays empty.
    """
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = pick(docs, "text", "string")
    rows = docs.select(payload.alias("doc"), pick(docs, "doc_id", "long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n"), sha256(without_blanks(text)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    cold, hot = _repeated(rows.select("digest"), "dedup-counts")
    inside = without_blanks(F.col("doc.text").cast("string")) if "text" in docs.columns else F.lit("")

    def winners(copies: DataFrame) -> DataFrame:
        return _combined(copies.withColumn("norm", inside), ["digest", "norm"], doc=F.col("doc")).select("doc.*")

    from_hot = winners(rows.join(F.broadcast(hot), "digest"))
    rest = rows.join(F.broadcast(hot), "digest", "left_anti").join(cold.withColumn("repeated", F.lit(True)).hint("merge"), "digest", "left")
    marked = stored(rest, "dedup-marked")
    return marked.filter("repeated is null").select("doc.*").unionByName(winners(marked.filter("repeated").drop("repeated"))).unionByName(from_hot)
