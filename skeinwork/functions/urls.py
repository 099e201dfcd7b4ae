"""URL parts and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.text import col

#: Beginnings of query keys that only track.
TRACKING = ("utm_", "mc_", "fbclid", "gclid")


def _split(c: Column) -> dict[str, Column]:
    bare = F.regexp_extract(c, "^([^#]*)", 1)
    return {
        "head": F.regexp_extract(bare, r"^([^?]*)", 1),
        "query": F.regexp_extract(bare, r"\?(.*)$", 1),
        "scheme": F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1),
        "host": F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1),
        "path": F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1),
    }


def host(c: Column | str) -> Column:
    return F.nullif(F.lower(_split(col(c))["host"]), F.lit(""))


def _coded(part: Column) -> Column:
    """Decoded and coded again, so equal values are spelt alike."""
    return F.url_encode(F.coalesce(F.try_url_decode(part), part))


def normalize_url(c: Column | str) -> Column:
    """Tracking keys and the fragment dropped; order, repeats and blank values of the query stay."""
    p = _split(col(c))
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")
    kept = F.filter(pairs, lambda x: ~F.lower(x).rlike("^(" + "|".join(TRACKING) + ")"))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_coded(F.regexp_extract(x, "^([^=]*)", 1)), F.lit("="), _coded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)))), "&")
    return F.when(query == "", p["head"]).otherwise(F.concat(p["head"], F.lit("?"), query))


def canonical_url(c: Column | str) -> Column:
    """normalize_url without a trailing slash, where more than the root has one."""
    u = normalize_url(c)
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
    return F.when(slashes > 2, F.regexp_replace(u, "/+$", "")).otherwise(u)


def url_key(c: Column | str) -> Column:
    """Scheme and host in lower case, no trailing slash but the root's, no fragment, query kept."""
    p = _split(F.trim(col(c)))
    path = F.when(F.regexp_replace(p["path"], "/+$", "") == "", F.when(p["path"] == "", F.lit("")).otherwise(F.lit("/"))).otherwise(F.regexp_replace(p["path"], "/+$", ""))
    return F.concat(F.lower(p["scheme"]), F.lit("://"), F.lower(p["host"]), path, F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])))


def external_id(c: Column | str) -> Column:
    """Last segment of the path."""
    return F.nullif(F.regexp_extract(_split(col(c))["path"], "([^/]*)/*$", 1), F.lit(""))


def links_in(c: Column | str) -> Column:
    """http(s) URLs of a text in order, first sight only, closing punctuation dropped."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")))
