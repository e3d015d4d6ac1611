"""Every registered query of the wind and city operators against its DuckDB twin, over whole tables."""

import os

import duckdb
import pytest

from windrift.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(v):
    return ("f", round(v, 9)) if isinstance(v, float) else v




@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(comparable, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    r = duck.sql(registry.ORACLES[name])
    assert sorted(r.columns) == columns
    want = sorted((tuple(map(comparable, x)) for x in r.select(",".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want
    kinds = dict(zip(r.columns, map(str, r.types), strict=True))
    for c, k in df.dtypes:
        assert KINDS.get(k, k) == kinds[c]


def test_every_query_is_named_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
