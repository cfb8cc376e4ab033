"""Every registered query against its SQL in DuckDB on the smallest tables, as the correctness gate does it."""

import math
import os

import duckdb
import pytest

from riverframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def normal(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert normal(df.select(*columns).collect()) == normal(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
