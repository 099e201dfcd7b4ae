"""What goes out: results a chat, texts to fall back on, artefact checks, prompts' payloads, review reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import col, sentences
from skeinwork.operators.summary import fallback_summary, sanitised_summary

URL = r"https?://\S+"
#: Labels before a text and phrases that end one.
PREFIXES = (r"^\s*insider brief\s*[:.\-]?\s*", r"^\s*brief\s*[:.\-]\s*", r"^\s*robotics & automation news\s*[:.\-]\s*", r"^\s*the robot report\s*[:.\-]\s*")
BOILERPLATE = (r"\bthe post .*? appeared first on .*", r"\bread more\b.*", r"\bsubscribe to .*")
#: What a week's message begins with, how long it may be and how many stories it has.
TITLE, MOST_SIGNS, LEAST_STORIES = "Top 5 News Highlights |", 4096, 5


def sent(cards: DataFrame, chats: Sequence[str], send: Callable[[str, str], str] | None = None) -> DataFrame:
    """card_id, chat_id, status, note: one result a card and chat, to be appended to the log.

    send(chat, html) gives a message id or raises; without it, or without a chat, a card is
    skipped. A task that is run again sends again: readers of the log take a card's first row.
    """
    rows = cards.select("card_id", "html", F.explode_outer(F.array(*map(F.lit, chats)) if chats else F.lit(None).cast("array<string>")).alias("chat_id"))
    if send is None or not chats:
        return rows.select("card_id", "chat_id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("note"))

    def tried(batches):
        for pdf in batches:
            out = []
            for card_id, html, chat in pdf.itertuples(index=False):
                try:
                    out.append((card_id, chat, "sent", send(chat, html)))
                except Exception as e:  # a chat that fails doesn't hold up the others
                    out.append((card_id, chat, "failed", f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["card_id", "chat_id", "status", "note"])

    kind = cards.schema["card_id"].dataType.simpleString()
    return rows.mapInPandas(tried, f"card_id {kind}, chat_id string, status string, note string")


def without_boilerplate(c: Column | str) -> Column:
    out = col(c)
    for p in (*PREFIXES, *BOILERPLATE):
        out = F.regexp_replace(out, f"(?i){p}", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def headline_sentence(title: Column | str) -> Column:
    """A headline of six words or more as a sentence; null for a shorter one."""
    t = F.trim(F.coalesce(col(title), F.lit("")))
    return F.when(F.size(F.split(t, r"\s+")) >= 6, F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))


def delivery_text(title: Column | str, preview: Column | str) -> Column:
    """The first that is fit to print: a summary of its own, the preview, the headline."""
    return F.coalesce(sanitised_summary(fallback_summary(col(title), col(preview))), sanitised_summary(col(preview)), headline_sentence(title))


def grounding(title: Column | str, summary: Column | str) -> Column:
    """What a digest may say of a story: its first two sentences, without links and labels."""
    base = F.coalesce(F.nullif(F.trim(F.coalesce(col(summary), F.lit(""))), F.lit("")), col(title))
    clean = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, URL, ""), r"(?i)^\s*insider brief[:\s\-]*", ""), r"\s+", " "), F.lit(" ."))
    parts = F.filter(F.transform(sentences(clean), lambda s: F.btrim(s, F.lit(" ."))), lambda s: s != "")
    return F.nullif(F.when(F.size(parts) == 0, clean).otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit("."))), F.lit(""))


def paragraph(text: Column, otherwise: Sequence[tuple[Column, str]], last: str) -> Column:
    """text without links and with a full stop; where nothing is left, the first paragraph whose condition holds, else the last."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), URL, ""), r"\s+", " "), F.lit(" ."))
    default = F.lit(last)
    for condition, words in reversed(otherwise):
        default = F.when(condition, F.lit(words)).otherwise(default)
    return F.when(clean == "", default).when(clean.rlike("[.!?]$"), clean).otherwise(F.concat(clean, F.lit(".")))


def artefact_problem(message: Column | str) -> Column:
    """Why a week's message can't go out, first that holds: title, length, stories, links, placeholder, url; null if it can."""
    m = col(message)
    visible = F.regexp_replace(m, '<a href="[^"]+">Link</a>', "Link")
    return (
        F.when(~m.startswith(TITLE), "title").when(F.length(m) >= MOST_SIGNS, "length").when(F.regexp_count(m, F.lit(r"(?m)^\s*\d+\.\s*<b>")) < LEAST_STORIES, "stories")
        .when(~(m.contains('<a href="') & m.contains(">Link</a>")), "links").when(m.contains("example.com"), "placeholder").when(visible.rlike("https?://"), "url")
    )


def payload(rows: DataFrame, order: Sequence[Column], columns: Sequence[str], n: int) -> DataFrame:
    """One row: the first n rows as a JSON array, in order."""
    first = rows.orderBy(*order).limit(n).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    listed = F.array_sort(F.collect_list(F.struct("_place", F.struct(*columns).alias("row"))))
    return first.agg(F.to_json(F.transform(listed, lambda x: x["row"])).alias("payload"))


def review_report(week: str, stories: DataFrame, examples: DataFrame, heading: str = "Weekly review") -> DataFrame:
    """line, text of a week's review without a model: five that weren't sent, three that were, three bad summaries.

    stories: title, source_id, score, sent, place; examples: title, feedback, kind, place.
    """
    label = lambda *parts: F.concat(F.lit("- "), *parts)
    score = F.concat(F.lit(" ("), "source_id", F.lit(", score "), F.col("score").cast("string"), F.lit(")"))
    sections = (
        ("Top Misses", stories.filter("not sent").orderBy("place").limit(5), label("title", score), "- Nothing was left unsent."),
        ("Weak Sends", stories.filter("sent").orderBy("place").limit(3), label("title", score), "- Nothing was sent."),
        ("Writing Failures", examples.filter("kind = 'summary_bad'").orderBy("place").limit(3), label("title", F.lit(": "), "feedback"), "- No bad summaries are on record."),
    )
    spark, out = stories.sparkSession, None
    for i, (head, rows, line, nothing) in enumerate(sections):
        fixed = spark.createDataFrame([(i, 0, 0, f"## {head}"), (i, 2, 0, nothing)], "section int, part int, place long, text string")
        listed = rows.select(F.lit(i).alias("section"), F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), line.alias("text"))
        both = fixed.unionByName(listed)
        none = rows.agg((F.count("*") == 0).alias("none"))
        one = both.join(F.broadcast(none)).filter("part < 2 or none").drop("none")
        out = one if out is None else out.unionByName(one)
    top = spark.createDataFrame([(-1, 0, 0, f"# {heading} | {week}")], "section int, part int, place long, text string")
    return top.unionByName(out).select(F.row_number().over(Window.orderBy("section", "part", "place", "text")).alias("line"), "text")
