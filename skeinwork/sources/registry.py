"""The source registry: a small dimension read from configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

SOURCE = "id string, name string, kind string, layer string, is_direct_source boolean, is_wrapper boolean, enabled boolean, parser string, url string, priority int, tags array<string>, extra_config map<string,string>"
NEEDED = tuple(c.split()[0] for c in SOURCE.split(", ")[:10])
#: Kinds of sources; listings need a parser of their own, and one kind is declared but has no reader.
KINDS = ("rss", "listing", "api", "google_competitor")
LISTING_PARSERS = ("links", "links_with_dates", "headings", "round_robin", "excerpts")


class UnsupportedSource(ValueError):
    pass


def sources(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Sources of configuration rows; what a row has beyond the known fields goes to extra_config."""
    out = []
    for row in rows:
        if missing := [k for k in NEEDED if k not in row]:
            raise ValueError(f"source {row.get('id')!r} lacks {', '.join(missing)}")
        if row["kind"] not in KINDS:
            raise UnsupportedSource(f"{row['id']}: {row['kind']}")
        extra = {k: str(v) for k, v in row.items() if k not in (*NEEDED, "tags")}
        out.append((*[row[k] for k in NEEDED], list(row.get("tags", ())), extra))
    return spark.createDataFrame(out, SOURCE)


def selected(df: DataFrame) -> DataFrame:
    return df.filter("enabled and is_direct_source")


def supported(df: DataFrame) -> DataFrame:
    """Sources that a reader exists for."""
    listed = ", ".join(f"'{p}'" for p in LISTING_PARSERS)
    return df.filter(f"kind = 'rss' or kind = 'api' or (kind = 'listing' and parser in ({listed}))")


def from_yaml(spark: SparkSession, text: str) -> DataFrame:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML; pass rows to sources() instead") from e
    return sources(spark, yaml.safe_load(text)["sources"])
