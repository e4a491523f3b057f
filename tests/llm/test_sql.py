"""The queries that SQL can express, on the whole tables of the smallest scale factor."""

import duckdb
import pytest

from equilens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    rows = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in rows.description]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows.fetchall(), key=str)
