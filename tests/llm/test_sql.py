"""The operators' queries against the SQL that says the same."""

from __future__ import annotations

import duckdb
import pytest

from tagmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(d[0] for d in cursor.description)
    assert sorted(tuple(r) for r in got.select(*[d[0] for d in cursor.description]).collect()) == sorted(tuple(r) for r in cursor.fetchall())


def test_every_operator_is_registered():
    names = queries.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == [n for n in sorted(names, key=lambda n: int("".join(filter(str.isdigit, n.split("_")[0])) or 99)) if n != "pipeline"]
    assert "pipeline" in names
