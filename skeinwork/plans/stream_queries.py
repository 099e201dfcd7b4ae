"""Queries of streams and of chat updates; updates are composed from the events table.

Every third event is a message, a change of reactions or a button press. Rows are landed in three
turns; the stream runs after each, goes on from its checkpoint and then runs its last batch again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.keyed_table import KeyedTable
from skeinwork.operators.shared import own_folder
from skeinwork.plans.registry import Tables, query
from skeinwork.sources import chat
from skeinwork.streaming import ingest, streams

TURNS = 3
ALLOWED, ALIASES = ("like", "emoji:B", "paid"), {"A": "like"}


def _lines(t: Tables) -> DataFrame:
    """event_id, value: an update as the chat service writes it; some lines aren't updates."""
    n = F.col("event_id")
    at, who = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date"), F.struct(F.col("user_id").alias("id"), (n % 2 == 0).alias("is_bot"))
    room, key = F.struct((-(F.col("user_id") % 5) - 1).alias("id")).alias("chat"), F.expr("event_id div 6").alias("message_id")
    user = F.col("user_id").cast("string")
    link = F.concat(F.lit("https://a.example.org/"), user)
    kind = F.expr("event_id div 3 % 3")
    text = F.when(kind == 0, F.concat(F.lit("see "), link, F.lit(", and "), link)).when(kind == 1, F.lit("no link")).otherwise(F.concat(F.lit("https://b.example.org/x https://c.example.org/"), n, F.lit("!")))
    hidden = F.when(kind == 0, F.array(F.struct(F.lit("text_link").alias("type"), F.concat(F.lit("https://d.example.org/"), user).alias("url"))))
    emoji = lambda e: F.struct(F.lit("emoji").alias("type"), F.lit(e).alias("emoji"))
    none = F.array(emoji("A"))
    old = F.when(n % 4 == 1, F.array(emoji("A"))).when(n % 4 == 3, F.array(emoji("B"), emoji("C"))).otherwise(F.slice(none, 1, 0))
    new = F.when(n % 5 == 0, F.slice(none, 1, 0)).when(n % 2 == 0, F.array(emoji("B"), F.struct(F.lit("paid").alias("type"), F.lit(None).cast("string").alias("emoji")))).otherwise(F.array(emoji("A")))
    told = {
        0: F.struct(n.alias("update_id"), F.struct(key, at, room, who.alias("from"), text.alias("text"), hidden.alias("entities")).alias("message")),
        1: F.struct(n.alias("update_id"), F.struct(key, at, room, F.struct(F.col("user_id").alias("id")).alias("user"), old.alias("old_reaction"), new.alias("new_reaction")).alias("message_reaction")),
        2: F.struct(n.alias("update_id"), F.struct(user.alias("id"), F.concat(F.col("event_type"), F.lit(":"), n).alias("data"), F.struct(F.col("user_id").alias("id")).alias("from")).alias("callback_query")),
    }
    value = F.when(n % 50 == 7, "not json").when(n % 3 == 0, F.to_json(told[0])).when(n % 3 == 1, F.to_json(told[1])).otherwise(F.to_json(told[2]))
    return t.events.select("event_id", value.alias("value"))


_READ = "SELECT *, event_id AS update_id, CAST(-(user_id % 5) - 1 AS VARCHAR) AS chat_id, CAST(event_id // 6 AS VARCHAR) AS message_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS told FROM events WHERE event_id % 50 <> 7"
_MESSAGES = f"""SELECT update_id, chat_id, message_id, event_id % 2 = 0 AS sent_by_bot, told AS message_ts,
    CASE event_id // 3 % 3 WHEN 0 THEN 'see https://a.example.org/' || user_id || ', and https://a.example.org/' || user_id WHEN 1 THEN 'no link' ELSE 'https://b.example.org/x https://c.example.org/' || event_id || '!' END AS text,
    CASE event_id // 3 % 3 WHEN 0 THEN 'https://a.example.org/' || user_id || ' https://d.example.org/' || user_id WHEN 1 THEN '' ELSE 'https://b.example.org/x https://c.example.org/' || event_id END AS urls, CAST(NULL AS VARCHAR) AS only_url
    FROM ({_READ}) WHERE event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id // 3 % 3 <> 1)"""
_PICKS = f"""SELECT update_id, chat_id, message_id, CAST(user_id AS VARCHAR) AS reactor_user_id, '' AS actor_chat_id, k AS reaction_key, told AS picked_at, list_contains(new, k) AS is_active FROM (
    SELECT *, CASE event_id % 4 WHEN 1 THEN ['like'] WHEN 3 THEN ['emoji:B'] ELSE [] END AS old, CASE WHEN event_id % 5 = 0 THEN [] WHEN event_id % 2 = 0 THEN ['emoji:B', 'paid'] ELSE ['like'] END AS new FROM ({_READ}) WHERE event_id % 3 = 1),
    unnest(list_distinct(list_concat(old, new))) x(k)"""


@query(_MESSAGES)
def chat_messages(t: Tables) -> DataFrame:
    return chat.messages(chat.updates(_lines(t))).withColumn("urls", F.array_join("urls", " "))


@query(_PICKS)
def chat_reactions(t: Tables) -> DataFrame:
    return chat.reactions(chat.updates(_lines(t)), ALLOWED, ALIASES)


@query("SELECT event_id AS update_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action, CAST(event_id AS VARCHAR) AS item_id FROM events WHERE event_id % 3 = 2 AND event_id % 50 <> 7")
def chat_presses(t: Tables) -> DataFrame:
    return chat.presses(chat.updates(_lines(t)))


def _drained_in_turns(t: Tables, df: DataFrame, base: str, order: str, stream: Callable[[str], DataFrame], sink, mode: str = "append", **landing) -> None:
    """Lands df in turns and runs the stream after each, then the last batch once more, as after a failure."""
    folder, checkpoint = f"{base}/landed", f"{base}/checkpoint"
    run = lambda: streams.drained(stream(folder), checkpoint, sink, mode)
    streams.landed(df, folder, order, TURNS, run, **landing)
    streams.forgotten(t.spark, checkpoint)
    run()


def _ingested(t: Tables) -> ingest.Ingest:
    base = own_folder(t.spark, "ingest")
    span = t.events.agg(F.max("event_id")).first()[0] or 0
    sink = ingest.Ingest(t.spark, f"{base}/tables", ALLOWED, ALIASES)
    _drained_in_turns(t, _lines(t), base, f"event_id div {span // TURNS + 1}", lambda folder: ingest.update_lines(t.spark, folder), sink, kind="text", columns=("value",))
    return sink


@query(f"SELECT * FROM ({_MESSAGES}) QUALIFY row_number() OVER (PARTITION BY chat_id, message_id ORDER BY update_id DESC) = 1")
def ingest_messages(t: Tables) -> DataFrame:
    return _ingested(t).messages.read().withColumn("urls", F.array_join("urls", " "))


@query(f"SELECT * FROM ({_PICKS}) QUALIFY row_number() OVER (PARTITION BY chat_id, message_id, reactor_user_id, actor_chat_id, reaction_key ORDER BY update_id DESC) = 1")
def ingest_picks(t: Tables) -> DataFrame:
    return _ingested(t).picks.read()


@query(f"""SELECT event_id // (m // {TURNS} + 1) AS batch, count(*) AS updates, count(*) FILTER (event_id IN (SELECT update_id FROM messages UNION ALL SELECT update_id FROM picks)) AS handled,
           CAST(sum((SELECT count(*) FROM messages x WHERE x.update_id = event_id)) AS BIGINT) AS messages, CAST(sum((SELECT count(*) FROM picks x WHERE x.update_id = event_id)) AS BIGINT) AS picks, max(max(event_id)) OVER () + 1 AS next_offset
           FROM events, (SELECT max(event_id) AS m FROM events) WHERE event_id % 50 <> 7 GROUP BY 1""".replace("FROM messages", f"FROM ({_MESSAGES})").replace("FROM picks", f"FROM ({_PICKS})"))
def ingest_counts(t: Tables) -> DataFrame:
    """What each batch read and stored, and the cursor after all."""
    sink = _ingested(t)
    return sink.counts.read().crossJoin(F.broadcast(sink.cursors.read().select("next_offset")))  # the cursor is one row


def _streamed(t: Tables, build: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """A table into which the stream merges each batch's changed keys."""
    base = own_folder(t.spark, "stream")
    table = KeyedTable(t.spark, f"{base}/state", key)
    with streams.on_disk_state(t.spark):
        _drained_in_turns(t, t.events, base, "event_id", lambda folder: build(streams.event_stream(t.spark, folder, t.events)), streams.merged_into(table, "stream"), "update")
    return table.read()


@query("SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(t: Tables) -> DataFrame:
    return _streamed(t, streams.latest_state, ["user_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, count(*) % 2 = 1 AS active FROM events GROUP BY 1, 2")
def stream_toggle(t: Tables) -> DataFrame:
    return _streamed(t, streams.toggle_states, ["user_id", "event_type"])


#: Lateness of the events is that of their order of landing: each turn spans all days.
_LATE = f"""WITH landed AS (SELECT *, event_id % {TURNS} AS batch FROM events), marks AS (SELECT b.batch, max(l.ts) AS high FROM (SELECT DISTINCT batch FROM landed) b LEFT JOIN landed l ON l.batch < b.batch GROUP BY b.batch),
    told AS (SELECT l.*, CASE WHEN high IS NULL OR ts >= high - INTERVAL 2 DAY THEN 'on time' WHEN ts >= high - INTERVAL 7 DAY THEN 'recovered' ELSE 'dropped' END AS status FROM landed l JOIN marks USING (batch))"""


def _split(t: Tables) -> streams.LateSplit:
    base = own_folder(t.spark, "late")
    sink = streams.LateSplit(t.spark, f"{base}/tables")
    _drained_in_turns(t, t.events, base, "event_id", lambda folder: streams.event_stream(t.spark, folder, t.events), sink)
    return sink


@query(_LATE + " SELECT batch, status, count(*) AS n FROM told GROUP BY ALL")
def stream_late(t: Tables) -> DataFrame:
    """Events on time, late and recovered, or dropped, by batch."""
    return _split(t).statuses()


@query(_LATE + " SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM told WHERE status <> 'dropped' GROUP BY 1, 2")
def stream_window(t: Tables) -> DataFrame:
    """Daily windows of what wasn't dropped."""
    return _split(t).windows()


@query("""SELECT s - to_days(CAST(b AS INT)) AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, event_type FROM events), range(2) r(b) GROUP BY 1, 2""")
def sliding_windows(t: Tables) -> DataFrame:
    """Windows of two days that start every day."""
    return streams.overlapping(t.events)


@query("""SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh FROM events)) GROUP BY user_id, run""")
def session_windows(t: Tables) -> DataFrame:
    """Runs of a user's events with less than six hours between neighbours."""
    return streams.sessions(t.events)
