"""Summaries from the text itself: excerpts, fallback summaries, cards."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skeinwork.functions.text import col, escaped

#: Signs of captions and of sentences without content.
CAPTIONS = ("image:", "photo:", "credit:", "courtesy of")
EMPTY_WORDS = ("click here", "read more", "learn more", "stay tuned", "find out more")
CLAUSES = (", which", ", while", ", as ", ", after", "; ", " - ")
FRAGMENT = re.compile(r"\b(and|or|the|a|an|of|to|for|with|in|on|by|as|at|from)[.!?]?$", re.IGNORECASE)


def split_sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def _tokens(s: str) -> set[str]:
    return {w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 2}


def similar(a: str, b: str, share: float = 0.75) -> bool:
    x, y = _tokens(a), _tokens(b)
    return bool(x and y) and len(x & y) / min(len(x), len(y)) >= share


def trim_sentence(s: str, words: int = 28) -> str:
    """Cut at the last clause that fits, else at the word; never on a dangling word."""
    parts = s.split()
    if len(parts) <= words:
        return s
    head = " ".join(parts[:words])
    at = max((head.rfind(c) for c in CLAUSES), default=-1)
    head = head[:at] if at > len(head) // 2 else head
    while " " in head and FRAGMENT.search(head):
        head = head.rsplit(" ", 1)[0]
    return head.rstrip(" ,;:-") + "."


def compress(text: str, most: int = 3) -> str:
    """The first sentences that say something new."""
    kept: list[str] = []
    for s in split_sentences(text):
        low = s.lower()
        if any(c in low for c in CAPTIONS) or any(c in low for c in EMPTY_WORDS) or len(s.split()) < 3 or any(similar(s, k) for k in kept):
            continue
        kept.append(trim_sentence(s))
        if len(kept) == most:
            break
    return " ".join(kept)


def summarise(title: str | None, preview: str | None) -> str | None:
    """The preview if it has two sentences to say, else the title as a sentence with what the preview adds."""
    title, short = (title or "").strip(), compress(preview or "")
    if len(split_sentences(short)) >= 2:
        return short
    head = title if not title or title[-1] in ".!?" else title + "."
    return " ".join(x for x in (head, short if short and not similar(head, short) else "") if x) or None


def sanitised(text: str | None) -> str | None:
    """Null for what isn't fit to print: too short, cut off, a fragment, a bare link."""
    x = re.sub(r"\s+", " ", text or "").strip()
    if len(x) < 20 or x.endswith(("...", "…")) or FRAGMENT.search(x) or re.fullmatch(r"https?://\S+", x) or not re.search("[.!?]$", x):
        return None
    return x


@F.pandas_udf(StringType())
def fallback_summary(title: pd.Series, preview: pd.Series) -> pd.Series:
    return pd.Series([summarise(a, b) for a, b in zip(title, preview)])


@F.pandas_udf(StringType())
def sanitised_summary(s: pd.Series) -> pd.Series:
    return s.map(sanitised)


def excerpt(paragraphs: Column, most: int = 3, limit: int = 900) -> Column:
    """The first paragraphs that fit together and aren't part of one taken before."""
    start = F.array().cast("array<string>")

    def take(done: Column, p: Column) -> Column:
        size = F.length(F.array_join(done, " ")) + F.length(p) + 1
        new = (F.size(done) < most) & (size <= limit) & (F.trim(p) != "") & ~F.exists(done, lambda d: F.contains(d, p))
        return F.when(new, F.array_append(done, p)).otherwise(done)

    return F.array_join(F.aggregate(paragraphs, start, take), " ")


def card(title: Column | str, summary: Column | str, url: Column | str) -> Column:
    """Three lines of HTML."""
    return F.concat_ws("\n", F.concat(F.lit("<b>"), escaped(title), F.lit("</b>")), escaped(summary), F.concat(F.lit('<a href="'), escaped(url), F.lit('">Read</a>')))


def card_problem(title: Column, summary: Column, url: Column, hype: Sequence[str] = ("game-changing", "revolutionary", "unprecedented")) -> Column:
    """Why a card can't go out: url, missing, hype, fragment, repeat, thin; null if it can."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    words = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.length(w) > 2)
    head = words(title)
    repeated = F.size(F.array_intersect(head, words(col(summary)))) >= 0.8 * F.size(head)
    return (
        F.when(~F.coalesce(url, F.lit("")).rlike("^https?://"), "url").when(F.trim(low) == "", "missing")
        .when(low.rlike("|".join(hype)), "hype").when(~low.rlike(r"[.!?]$"), "fragment")
        .when((F.size(head) > 0) & repeated & (F.size(words(col(summary))) <= F.size(head) + 2), "repeat").when(F.size(F.split(F.trim(low), r"\s+")) < 6, "thin")
    )
