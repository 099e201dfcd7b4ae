"""Text normalisation, tokens and similarity as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no title identity.
TITLE_STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "this", "that", "will", "after", "amid",
    "over", "about", "major", "new", "says", "report", "reports", "launches", "launch", "announces", "announce",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Blanks collapsed and trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), F.lit(""))


def story_text(c: Column | str) -> Column:
    """Lower case, everything but ASCII letters and digits as one blank; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def match_text(s: pd.Series) -> pd.Series:
    """ASCII fold (NFKD), lower case, other signs as blanks, one blank at each side."""

    def one(x: str | None) -> str:
        folded = unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().lower()
        return f" {' '.join(re.sub('[^a-z0-9]+', ' ', folded).split())} "

    return s.map(one)


def clean_html(x: str | None) -> str | None:
    """Entities first, tags second, then blanks; nothing left is null."""
    plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(x or ""))).strip()
    return plain or None


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """clean_html of each."""
    return s.map(clean_html)


def title_of(c: Column | str, size: int = 80) -> Column:
    """A document's stand-in for a title: its first line's beginning."""
    return F.substring(F.regexp_extract(F.coalesce(col(c), F.lit("")), "^[^\n]*", 0), 1, size)


def tokens(c: Column | str) -> Column:
    """Title tokens in order: ASCII words of three signs or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP_WORDS))


def event_key(c: Column | str) -> Column:
    """The first six tokens, joined; `untitled` without any."""
    return F.coalesce(F.nullif(F.array_join(F.slice(tokens(c), 1, 6), "-"), F.lit("")), F.lit("untitled"))


def overlap(left: Column, right: Column) -> Column:
    """Shared part of the smaller of two token sets; 0 if either is empty.

    It is never below their Jaccard similarity, so it is the larger of the two measures.
    """
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def sentences(c: Column | str) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"(?<=[.!?])\s+"), lambda s: s != "")


def cut_words(c: Column | str, limit: int, ellipsis: str = "") -> Column:
    """At most limit signs, cut at the last blank that fits."""
    x = col(c)
    head = F.substring(x, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.when(cut == "", head).otherwise(cut)), F.lit(ellipsis)))


def without_labels(c: Column | str) -> Column:
    """Leading labels such as `Report:` stripped."""
    return F.trim(F.regexp_replace(col(c), r"(?i)^((exclusive|report|reuters|update|analysis|interview)\s*:\s*)+", ""))


def escaped(c: Column | str) -> Column:
    """For HTML text."""
    return F.replace(F.replace(F.replace(col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def table_cell(c: Column | str) -> Column:
    """For a Markdown table."""
    return F.replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))
