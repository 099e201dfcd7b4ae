"""Ingest of chat updates: a stream of landed lines, merged into tables of messages and reaction picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.keyed_table import KeyedTable
from skeinwork.sources import chat


@dataclass(frozen=True)
class Switches:
    enabled: bool = True
    messages: bool = True
    reactions: bool = True


class Ingest:
    """A sink for update lines: both merges bear the batch's number, so a batch that runs again changes nothing.

    A message's last update counts, whole: its links are replaced with it. A pick is one key's
    reaction by one user to a message; its last change counts. The cursor is one beyond the
    largest update id that was read, whether or not the update says anything. counts: lines that
    were updates, those that were stored, messages and picks of each batch. Lines that aren't
    updates are passed over; what is switched off is read but not stored.
    """

    def __init__(self, spark: SparkSession, folder: str, allowed: Sequence[str], aliases: Mapping[str, str], switches: Switches = Switches(), name: str = "chat") -> None:
        self.spark, self.allowed, self.aliases, self.switches, self.name = spark, tuple(allowed), dict(aliases), switches, name
        self.messages = KeyedTable(spark, f"{folder}/messages", ["chat_id", "message_id"])
        self.picks = KeyedTable(spark, f"{folder}/picks", ["chat_id", "message_id", "reactor_user_id", "actor_chat_id", "reaction_key"])
        self.cursors = KeyedTable(spark, f"{folder}/cursors", ["name"])
        self.counts = KeyedTable(spark, f"{folder}/counts", ["batch"])

    def __call__(self, lines: DataFrame, batch: int) -> None:
        s = self.switches
        if not s.enabled:
            return
        ups = chat.updates(lines).persist()
        try:
            messages = chat.messages(ups) if s.messages else chat.messages(ups.limit(0))
            picks = chat.reactions(ups, self.allowed, self.aliases) if s.reactions else chat.reactions(ups.limit(0), self.allowed, self.aliases)
            self.messages.merge(messages, "update_id", self.name, batch)
            self.picks.merge(picks, "update_id", self.name, batch)
            stored = messages.select("update_id", F.lit(1).alias("m")).unionByName(picks.select("update_id", F.lit(0).alias("m")))
            by_update = stored.groupBy("update_id").agg(F.sum("m").alias("messages"), F.count_if(F.col("m") == 0).alias("picks"))
            told = ups.select("update_id").join(by_update, "update_id", "left").agg(F.count("*").alias("updates"), F.count("messages").alias("handled"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum("picks"), F.lit(0)).alias("picks"))
            self.counts.merge(told.select(F.lit(batch).cast("long").alias("batch"), "*"), writer=self.name, batch=batch)
            # The cursor last: until it moves, the batch counts as not done. It never moves back.
            seen, old = chat.next_offset(ups), self.cursors.read()
            next_offset = seen.select(F.lit(self.name).alias("name"), "next_offset")
            if old is not None:
                next_offset = next_offset.unionByName(old.filter(F.col("name") == self.name)).groupBy("name").agg(F.max("next_offset").alias("next_offset"))
            self.cursors.merge(next_offset.filter("next_offset is not null"), writer=self.name, batch=batch)
        finally:
            ups.unpersist()


def update_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Landed lines as a stream; a trigger reads what is new."""
    return spark.readStream.text(folder)
