"""Every query with an oracle gives what DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from tagmill import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_agrees_with_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    want_columns = [d[0] for d in cursor.description]
    assert columns == sorted(want_columns)
    want = sorted((tuple(r[want_columns.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
