"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(data, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    fine = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(columns), sorted((tuple(fine(r[k]) for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.sql(registry.oracle_sql()[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), got.columns)
