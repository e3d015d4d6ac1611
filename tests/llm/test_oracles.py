"""Registered corpus queries that SQL can express, against DuckDB over whole tables."""

import os

import duckdb
import pytest

from windrift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, r = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got == sorted(r.select(",".join(columns)).fetchall(), key=repr)
    kinds = dict(zip(r.columns, map(str, r.types), strict=True))
    assert all(KINDS[k] == kinds[c] for c, k in df.dtypes)
