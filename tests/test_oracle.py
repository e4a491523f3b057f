"""Every registered query with an oracle statement against DuckDB at sf0.001
(the driver's gate runs the same comparison at sf0.01)."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from equilens.plans import catalog
from equilens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
KEYS = sorted(catalog.oracle_sql())


def _norm_rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for row in pdf[cols].itertuples(index=False, name=None):
        vals = []
        for v in row:
            if v is None or v is pd.NA or (isinstance(v, float) and v != v):
                vals.append("NULL")
            elif isinstance(v, (bool, np.bool_)):
                vals.append(str(bool(v)))
            elif isinstance(v, (int, float, np.integer, np.floating)):
                f = round(float(v), 6) + 0.0
                vals.append(str(int(f)) if f.is_integer() else repr(f))
            else:
                vals.append(str(v))
        out.append("|".join(vals))
    return hashlib.md5("\n".join(sorted(out)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF)
    want = {r[0]: r[1] for r in con.execute("DESCRIBE " + entry.oracle_sql()[key]).fetchall()}
    got = {f.name: SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    assert got == want
    s = sdf.toPandas()
    o = con.execute(entry.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _norm_rows(s) == _norm_rows(o)
