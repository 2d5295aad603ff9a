"""Every registered query of the library against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog
from tessera.sources.tables import TABLES

#: A larger scale may be given in TESSERA_TEST_SF.
DATA = f"/root/testdata/sf{os.environ.get('TESSERA_TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def coarse(row):
    """For the order: what differs in the last digits is in one place in both."""
    return repr(tuple(round(x, 3) if isinstance(x, float) else x for x in row))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=coarse)


def alike(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    ours, theirs = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(ours) == len(theirs)
    assert [(a, b) for a, b in zip(ours, theirs, strict=True) if not alike(a, b)] == []


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"nearest_neighbours"}  # see test_neighbours.py


def test_theta_join_has_all_pairs(spark):
    """Whatever their distance, in more join keys than there are nations."""
    have = spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal").collect()
    got = catalog.QUERIES["theta_join"](spark, DATA)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((x[0], y[0]) for x in have for y in have if x[1] == y[1] and x[2] < y[2])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_salt" in plan
