"""Dates of feeds, and the Friday-to-Thursday week."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.extract import let
from skeinwork.functions.text import col

#: Months by their German names.
GERMAN_MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Zone names that feeds still use, as offsets.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_time(c: Column | str) -> Column:
    """A feed's date, ISO or mail style, with or without weekday and zone (none: UTC); else null."""
    x = F.trim(F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]{3,9},\s*", ""))
    for name, offset in ZONES.items():
        x = F.regexp_replace(x, rf"(?<=[\d ]){name}$", f" {offset}" if name == "Z" else offset)
    x = F.regexp_replace(x, r"\s+", " ")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")
    return F.coalesce(let(x, lambda v: F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in forms])), F.try_to_timestamp(F.trim(col(c))))


def german_date(c: Column | str) -> Column:
    """`3. März 2024`, else `03.03.2024`: the first anywhere in a text, if there is such a day."""
    x = col(c)
    long = rf"(?i)(\d{{1,2}})\.\s*({'|'.join(GERMAN_MONTHS)}|Maerz)\s+(\d{{4}})"
    name = F.replace(F.lower(F.regexp_extract(x, long, 2)), F.lit("maerz"), F.lit("märz"))
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in GERMAN_MONTHS]), name).cast("string")
    written = F.try_to_date(F.concat_ws("-", F.regexp_extract(x, long, 3), month, F.regexp_extract(x, long, 1)), "y-M-d")
    return F.when(name != "", written).otherwise(F.try_to_date(F.regexp_extract(x, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), "d.M.y"))


def english_date(c: Column | str) -> Column:
    """`3 March 2024`, the first anywhere in a text, if there is such a day."""
    return F.try_to_date(F.regexp_replace(F.regexp_extract(col(c), rf"\b(\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}})\b", 1), r"\s+", " "), "d MMMM y")


def week_end(day: Column | str) -> Column:
    """The Thursday that closes the day's week, which starts on a Friday."""
    return F.next_day(F.date_sub(F.to_date(col(day)), 1), "Thu")


def week_key(day: Column | str) -> Column:
    """ISO year and week of that Thursday, as 2024-W05."""
    end = week_end(day)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), end).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(end).cast("string"), 2, "0"))


def range_label(start: Column, end: Column) -> Column:
    """As short as month and year allow."""
    same_year = F.year(start) == F.year(end)
    left = F.when(same_year & (F.month(start) == F.month(end)), F.date_format(start, "d")).when(same_year, F.date_format(start, "d MMMM")).otherwise(F.date_format(start, "d MMMM yyyy"))
    return F.concat(left, F.lit("-"), F.date_format(end, "d MMMM yyyy"))


def freshness(published: Column, collected: Column, now: Column, hours: int = 30, require_published: bool = True, fall_back: bool = False) -> Column:
    """fresh, stale or missing; both ends of the lookback count, the future doesn't."""
    floor = now - F.make_interval(hours=F.lit(hours))
    unknown = F.lit("missing") if require_published and not fall_back else F.when(collected >= floor, "fresh").otherwise("stale")
    return F.when(published.isNull(), unknown).when(published.between(floor, now), "fresh").otherwise("stale")
