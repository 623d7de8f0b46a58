"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9))
        return x if x is None or isinstance(x, str) else str(x)

    return [columns[i] for i in order], sorted(str([value(r[i]) for i in order]) for r in rows)


def duck(sf: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(SF).sql(entry.oracle_sql()[name])
    assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
