"""As-of joins and sessions with a key that has most rows, against the plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import groups, joins, slices
from tessera.sources.saved import saved


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    at = lambda: None if rng.random() < 0.02 else int(rng.expovariate(1 / 400))  # noqa: E731  times are dense at their beginning
    left = spark.createDataFrame([(i, key(), at(), "l") for i in range(3000)], "id long, k string, t long, _slice string")
    right = spark.createDataFrame([(key(), at() if rng.random() < 0.9 else 5000, i) for i in range(700)], "k string, u long, v long")
    return saved(left, "left"), saved(right, "right")


def listed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("rows", [10_000, 60])
def test_asof_equals_the_plain_join(tables, rows):
    left, right = tables
    plain = joins.asof_join(left, right, ["k"], "t", "u", ["v"])
    got = slices.asof_join(left, right, ["k"], "t", "u", ["v"], slice_rows=rows)
    assert got.columns == plain.columns and listed(got) == listed(plain)
    ties = slices.asof_join(left, right, ["k"], "t", "u", ["v"], ties=[-F.col("v")], slice_rows=rows)
    assert listed(ties) == listed(joins.asof_join(left, right, ["k"], "t", "u", ["v"], ties=[-F.col("v")]))


def test_no_slice_holds_a_key(tables):
    left, right = tables
    cuts = slices.bounds([(left, "t"), (right, "u")], ["k"], 100, ["_k"])
    assert cuts.count() >= 1
    per = slices.sliced(left, "t", ["k"], cuts, ["_k"], "part").groupBy("k", "part").count().collect()
    assert max(r["count"] for r in per if r.k == "hot") < 300 and sum(r["count"] for r in per) == 3000
    assert slices.bounds([(left, "t")], ["k"], 10_000, ["_k"]) is None


def test_asof_of_gaps_between_slices(spark):
    """Slices without right rows, and right rows long before."""
    left = spark.createDataFrame([(i, "k", i) for i in range(500)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 3, "x"), ("k", 450, "y")], "k string, u int, v string")
    got = {r.id: r.r_v for r in slices.asof_join(left, right, ["k"], "t", "u", ["v"], slice_rows=20).collect()}
    assert got == {i: None if i < 3 else "x" if i < 450 else "y" for i in range(500)}
    assert slices.asof_join(left.limit(0), right.limit(0), ["k"], "t", "u", ["v"], slice_rows=0).collect() == []


@pytest.mark.parametrize("rows,gap", [(10_000, 3), (200, 0.5), (200, 60), (20, 3)])
def test_sessions_equal_the_plain_ones(spark, rows, gap):
    rng = random.Random(rows)
    made = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), None if rng.random() < 0.02 else rng.randrange(4000)) for _ in range(1500)]
    df = spark.createDataFrame(made, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("_slice"))
    step = f"{gap} seconds"
    plain = groups.sessions(df, ["k"], "ts", step)
    got = slices.sessions(df, ["k"], "ts", step, slice_rows=rows)
    assert got.columns == plain.columns and listed(got) == listed(plain)
