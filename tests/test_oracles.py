"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from ledgerline.plans.catalog_listings import catalog

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.10g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(name, spark, duck):
    df = catalog.queries()[name](spark, str(TABLES))
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark):
    assert catalog.queries()[name](spark, str(TABLES)).count() > 0
