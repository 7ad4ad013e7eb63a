"""Every corpus query that has SQL against that SQL, on the smallest tables."""

import os

import pytest

from thicket.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    assert columns == sorted(got.columns)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
