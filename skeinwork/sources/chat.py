"""Chat updates: messages with their links, reaction changes, button presses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.urls import links_in

_REACTION = "array<struct<type:string,emoji:string,custom_emoji_id:string>>"
_MESSAGE = "struct<message_id:bigint,date:bigint,chat:struct<id:bigint>,from:struct<id:bigint,is_bot:boolean>,sender_chat:struct<id:bigint>,text:string,caption:string,entities:array<struct<type:string,offset:int,length:int,url:string>>>"
UPDATE = f"struct<update_id:bigint,message:{_MESSAGE},channel_post:{_MESSAGE},message_reaction:struct<message_id:bigint,date:bigint,chat:struct<id:bigint>,user:struct<id:bigint>,actor_chat:struct<id:bigint>,old_reaction:{_REACTION},new_reaction:{_REACTION}>,callback_query:struct<id:string,data:string,from:struct<id:bigint,username:string>>>"


def updates(lines: DataFrame) -> DataFrame:
    """Update rows of JSON lines (value); lines that aren't updates are dropped."""
    return lines.select(F.from_json("value", UPDATE).alias("u")).filter("u.update_id is not null").select("u.*")


def messages(ups: DataFrame) -> DataFrame:
    """Messages of bots, and of others those that carry a link; links of text and entities, first sight in order."""
    m = ups.select("update_id", F.coalesce("message", "channel_post").alias("m")).filter("m.chat.id is not null and m.message_id is not null")
    hidden = F.filter(F.transform(F.coalesce("m.entities", F.from_json(F.lit("[]"), "array<struct<type:string,offset:int,length:int,url:string>>")), lambda e: e["url"]), lambda u: u.isNotNull())
    out = m.select(
        "update_id", F.col("m.chat.id").cast("string").alias("chat_id"), F.col("m.message_id").cast("string").alias("message_id"), F.coalesce("m.from.is_bot", F.lit(False)).alias("sent_by_bot"),
        F.timestamp_seconds("m.date").alias("message_ts"), F.coalesce("m.text", "m.caption").alias("text"), F.array_distinct(F.concat(links_in(F.coalesce("m.text", "m.caption")), hidden)).alias("urls"),
    )
    return out.filter("sent_by_bot or size(urls) > 0").withColumn("only_url", F.when(F.size("urls") == 1, F.col("urls")[0]))


def reaction_key(r: Column, aliases: Mapping[str, str]) -> Column:
    named = F.coalesce(*[F.when(r["emoji"] == k, F.lit(v)) for k, v in aliases.items()], F.concat(F.lit("emoji:"), r["emoji"])) if aliases else F.concat(F.lit("emoji:"), r["emoji"])
    return F.when((r["type"] == "emoji") & (r["emoji"] != ""), named).when(r["type"] == "custom_emoji", F.concat(F.lit("custom_emoji:"), r["custom_emoji_id"])).when(r["type"] == "paid", F.lit("paid"))


def reactions(ups: DataFrame, allowed: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """A row per allowed key that was or is set: active if it is set now."""
    r = ups.select("update_id", "message_reaction.*").filter("chat.id is not null and message_id is not null")
    keys = lambda c: F.filter(F.transform(F.coalesce(c, F.from_json(F.lit("[]"), _REACTION)), lambda x: reaction_key(x, aliases)), lambda k: k.isNotNull())
    r = r.withColumns({"old": keys("old_reaction"), "new": keys("new_reaction")})
    both = F.array_intersect(F.array_union("old", "new"), F.array(*map(F.lit, allowed)))
    return r.select(
        "update_id", F.col("chat.id").cast("string").alias("chat_id"), F.col("message_id").cast("string").alias("message_id"), F.coalesce(F.col("user.id").cast("string"), F.lit("")).alias("reactor_user_id"),
        F.coalesce(F.col("actor_chat.id").cast("string"), F.lit("")).alias("actor_chat_id"), F.explode(F.array_sort(both)).alias("reaction_key"), F.timestamp_seconds("date").alias("picked_at"), "new",
    ).withColumn("is_active", F.array_contains("new", F.col("reaction_key"))).drop("new")


def presses(ups: DataFrame) -> DataFrame:
    """Button presses: what, of which item, by whom."""
    c = ups.filter("callback_query is not null").select("update_id", "callback_query.data", F.col("callback_query.from.id").cast("string").alias("user_id"))
    return c.select("update_id", "user_id", F.split("data", ":", 2)[0].alias("action"), F.get(F.split("data", ":", 2), F.lit(1)).alias("item_id"))


def next_offset(ups: DataFrame) -> DataFrame:
    return ups.agg((F.max("update_id") + 1).alias("next_offset"))
