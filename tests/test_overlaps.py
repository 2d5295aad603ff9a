"""Interval overlaps against the nested loop."""

import random

import pytest

from tessera.operators import overlaps


def intervals(rng, n, kinds=("a", "b", None)):
    out = []
    for i in range(n):
        low = rng.choice([rng.uniform(-1000, 1000), float(rng.randrange(-40, 40))])
        length = rng.choice([0.0, 0.3, 1.0, 4.0, 17.0, 64.0, 300.0, 1500.0])
        out.append((i, rng.choice(kinds), rng.choice([low, low, low, None]), low + length if rng.random() < 0.95 else low - 1))
    return out


@pytest.mark.parametrize("base", [1.0, 0.01, 500.0])
def test_each_pair_once(spark, base):
    rng = random.Random(4)
    one, two = intervals(rng, 250), intervals(rng, 250)
    left = spark.createDataFrame(one, "i int, k string, s double, e double")
    right = spark.createDataFrame(two, "j int, k string, low double, high double")
    got = sorted((r.i, r.j) for r in overlaps.overlap_join(left, right, ["k"], ("s", "e"), ("low", "high"), base).collect())
    ok = lambda x: x[2] is not None and x[2] <= x[3]
    want = sorted((a[0], b[0]) for a in one for b in two if ok(a) and ok(b) and a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want and len(want) > 1000


def test_without_keys_and_empty(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 20, 20), (3, -10**9, 10**9)], "i int, s long, e long")
    right = spark.createDataFrame([(1, 10, 11), (2, 20, 10**6), (3, -5, -5)], "j int, low long, high long")
    got = sorted((r.i, r.j) for r in overlaps.overlap_join(left, right, [], ("s", "e"), ("low", "high")).collect())
    assert got == [(1, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    assert overlaps.overlap_join(left.limit(0), right, [], ("s", "e"), ("low", "high")).collect() == []
    assert overlaps.overlap_join(left, right.limit(0), [], ("s", "e"), ("low", "high")).collect() == []
    with pytest.raises(ValueError):
        overlaps.overlap_join(left, left, [], ("s", "e"), ("s", "e"))


def test_rows_after_exploding(spark):
    """Long intervals meet short ones without being cut into the short ones' buckets."""
    short = spark.createDataFrame([(i, float(i), i + 0.5) for i in range(2000)], "i int, s double, e double")
    long = spark.createDataFrame([(j, 0.0, 2000.0) for j in range(20)], "j int, low double, high double")
    joined = overlaps.overlap_join(short, long, [], ("s", "e"), ("low", "high"))
    assert joined.count() == 40_000
    kinds = [r[0] for r in long.select(overlaps.scale(long.low, long.high, 1.0)).distinct().collect()]
    assert kinds == [6]


@pytest.mark.parametrize("most", [0, 70, 10**9])
def test_light_and_heavy_keys(spark, monkeypatch, most):
    """Keys with few rows on a side are joined without repeating rows, the others in buckets, to the same pairs."""
    monkeypatch.setattr(overlaps, "LIGHT", most)
    rng = random.Random(8)
    one, two = intervals(rng, 250, ("a", "b", "c", "c", None)), intervals(rng, 300, ("a", "c", "c", None, "d"))
    left = spark.createDataFrame(one, "i int, k string, s double, e double")
    right = spark.createDataFrame(two, "j int, k string, low double, high double")
    joined = overlaps.overlap_join(left, right, ["k"], ("s", "e"), ("low", "high"))
    ok = lambda x: x[2] is not None and x[2] <= x[3]
    want = sorted((a[0], b[0]) for a in one for b in two if ok(a) and ok(b) and a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((r.i, r.j) for r in joined.collect()) == want and len(want) > 1000
    assert ("Generate" in joined._jdf.queryExecution().executedPlan().toString()) == (most < 10**9)
    assert joined.columns == ["i", "k", "s", "e", "j", "low", "high"]
