"""Answers of external models as columns: read tolerantly, decided by plain rules, absent by default."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def json_object(text: str | None) -> str | None:
    """The one JSON object of an answer: whole, fenced, or the first that decodes; null if several or none."""
    text = (text or "").strip()
    fence = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", text, re.S)
    decoder = json.JSONDecoder()
    for body in filter(None, (text, fence and fence[1])):
        for start in (m.start() for m in re.finditer(r"\{", body)):
            try:
                found, end = decoder.raw_decode(body, start)
            except ValueError:
                continue
            if isinstance(found, dict) and "{" not in body[end:]:
                return json.dumps(found, sort_keys=True, ensure_ascii=False)
            break
    return None


@F.pandas_udf(StringType())
def answer_json(s: pd.Series) -> pd.Series:
    return s.map(json_object)


REVIEW = "struct<decision:string,confidence:string,bucket:string,reason:string,edited_title:string,edited_summary:string>"


def review(answer: Column) -> Column:
    """struct of a review's fields; null for an answer that isn't one."""
    r = F.from_json(answer_json(answer), REVIEW)
    valid = r["decision"].isin("promote", "reject", "keep") & r["confidence"].isin("low", "medium", "high")
    return F.when(F.coalesce(valid, F.lit(False)), r)


def outcome(review_: Column, protected: Column, promotable: Column) -> Column:
    """What a review changes: high confidence decides unless the item is protected, medium promotes what may be promoted and has been given a title and a summary; without a review nothing."""
    edited = F.coalesce((F.trim(review_["edited_title"]) != "") & (F.trim(review_["edited_summary"]) != ""), F.lit(False))
    sure, middling = review_["confidence"] == "high", (review_["confidence"] == "medium") & edited
    return (
        F.when(review_.isNull(), "not_reviewed").when(sure & (review_["decision"] == "promote"), "promoted").when(sure & (review_["decision"] == "reject") & protected, "protected")
        .when(sure & (review_["decision"] == "reject"), "rejected").when(middling & (review_["decision"] == "promote") & promotable, "promoted").otherwise("unchanged")
    )


def eligible(fresh: Column, kept: Column, skipped: Column, shortlisted: Column, borderline: Column, score: Column, send: float, margin: float = 6) -> Column:
    """Whether a reviewer sees an item: fresh, kept and not skipped, and listed, borderline or nearly good enough to be sent."""
    return F.coalesce(fresh & kept & ~skipped & (shortlisted | borderline | (score >= send - margin)), F.lit(False))


def duplicate_accepted(same: Column, confidence: Column, age_days: Column) -> Column:
    """A reviewer's duplicate counts within a week at medium confidence, within two at high."""
    return F.coalesce(same & ((confidence.isin("medium", "high") & age_days.between(0, 7)) | ((confidence == "high") & age_days.between(8, 14))), F.lit(False))


def follow_up(signalled: Column, url: Column, matched_url: Column, title: Column, matched_title: Column, age_days: Column) -> Column:
    """Whether a story that a reviewer calls a duplicate is news of its own after all.

    signalled: it comes from a source of that role and bears the signal that allows this. Its match
    has to be another page under another title, at least a week older; what isn't known is no.
    """
    known = F.trim(F.coalesce(matched_url, F.lit("")))
    other = F.lower(F.trim(title)) != F.lower(F.trim(F.coalesce(matched_title, F.lit(""))))
    return F.coalesce(signalled & (known != "") & (known != url) & other & (age_days >= 7), F.lit(False))


def memory_context(rules: Column, examples: Column, rule_scope: str, most: int = 8) -> Column:
    """Active rules of a scope and the first examples, as prompt lines."""
    active = F.transform(F.filter(rules, lambda r: r["active"] & F.array_contains(r["scopes"], rule_scope)), lambda r: F.concat(F.lit("- "), r["text"]))
    return F.array_join(F.concat(active, F.transform(F.slice(examples, 1, most), lambda e: F.concat(F.lit("* "), e))), "\n")
