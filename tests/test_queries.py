"""Every registered query against its SQL; those without SQL give rows with a stable schema."""

from __future__ import annotations

import os

import duckdb
import pytest

from skeinwork.plans import delivery_queries, history_queries, listing_queries, rank_queries, relational_queries, ruleset_queries, source_queries, stream_queries, text_queries  # noqa: F401
from skeinwork.plans.registry import QUERIES, SQL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _rows(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = _rows(tuple(r) for r in got.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    wanted = duck.sql(SQL[name])
    assert sorted(wanted.columns) == columns
    assert rows == _rows(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall())
