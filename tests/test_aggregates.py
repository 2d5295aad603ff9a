"""Sketches rolled up, exact quantiles, samples and reachable pairs, against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles, reach, samples, sketches


def test_rolled_up_sketches_are_within_their_bounds(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(6), int(rng.paretovariate(0.7)) % 900 if rng.random() < 0.97 else None, rng.gauss(0, 5)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, h int, item long, x double")
    fine = sketches.sketches(df, ["g", "h"], "item", "x", "item", share=0.02)
    depth, width = sketches.cell_sizes(0.02, 0.001)
    for by in (["g"], []):
        out = {tuple(r[b] for b in by): r for r in sketches.rolled_up(fine, by, share=0.02).collect()}
        truth = defaultdict(list)
        for g, _, item, x in rows:
            truth[(g,) if by else ()].append((item, x))
        assert set(out) == set(truth)
        for k, have in truth.items():
            counts = Counter(i for i, _ in have if i is not None)
            state = spark.createDataFrame([(out[k].hll, out[k].kll, out[k].cm)], "hll binary, kll binary, cm struct<cells: array<long>, n: long>")
            got = state.select(F.hll_sketch_estimate("hll").alias("d"), F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("m"), "cm").first()
            assert abs(got.d - len(counts)) <= 0.05 * len(counts) and got.cm.n == len(have)
            assert abs(np.mean([x <= got.m for _, x in have]) - 0.5) < 0.03
            items = spark.createDataFrame([(i,) for i in counts], "item long").crossJoin(state)
            seen = {r.item: r.f for r in items.select("item", sketches.frequency(F.col("cm"), F.col("item"), depth, width).alias("f")).collect()}
            assert all(counts[i] <= seen[i] <= counts[i] + 0.02 * len(have) for i in counts)


def test_merging_is_the_sketch_of_the_whole(spark):
    df = spark.range(3000).select((F.col("id") % 5).alias("h"), (F.col("id") % 77).alias("item"))
    depth, width = 3, 40
    fine = sketches.count_min(df, ["h"], "item", depth, width, "cm")
    whole = sketches.count_min(df, [], "item", depth, width, "cm").first().cm
    assert sketches.merge_count_min(fine, [], "cm", depth * width, "cm").first().cm == whole
    empty = sketches.count_min(df.select("h", F.lit(None).cast("long").alias("item")), ["h"], "item", depth, width, "cm").first().cm
    assert sum(empty.cells) == 0 and empty.n == 600


@pytest.mark.parametrize("bins", [4, 1024])
def test_exact_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), 1e9 * rng.random(), None, float("nan")])) for _ in range(2000)]
    rows += [("one", 5.0), ("none", None), ("two", -1.0), ("two", 1.7e308)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.g: r.quantiles for r in quantiles.exact_quantiles(df, ["g"], "x", shares).collect()}
    clean = defaultdict(list)
    for g, x in rows:
        clean[g] += [x] if x is not None and x == x else []
    assert set(got) == set(clean)
    for g, xs in clean.items():
        want = [None] * 5 if not xs else np.quantile(xs, shares).tolist()
        assert got[g] == (want if not xs else pytest.approx(want, rel=1e-12))
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "x", shares).collect() == []
    assert quantiles.exact_quantiles(df, [], "x", [0.5]).count() == 1
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(spark.createDataFrame([(1.0,), (float("-inf"),)], "x double"), [], "x", [0.5])


def test_samples_are_the_first_by_digest(spark):
    rows = [(i, "hot" if i % 10 else None if i % 20 else "few", "v") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, s string, _part string")
    got = samples.sampled(df, ["s"], ["id"], 60, seed=9).collect()
    for s in ("hot", "few", None):
        own = sorted((i for i, t, _ in rows if t == s), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())
        assert sorted(r.id for r in got if r.s == s) == sorted(own[:60])
        assert sum(r.weight for r in got if r.s == s) == pytest.approx(len(own))
    assert sorted(r.id for r in samples.sampled(df.repartition(7), ["s"], ["id"], 60, seed=9).collect()) == sorted(r.id for r in got)
    assert samples.sampled(df, [], ["id"], 5).count() == 5 and samples.sampled(df.limit(0), ["s"], ["id"], 5).collect() == []
    same = spark.createDataFrame([(1, "a")] * 20, "id int, s string")
    assert samples.sampled(same, ["s"], ["id"], 3).count() == 3


def closure(edges, starts=None):
    out = {}
    for a in starts or {x for x, _ in edges}:
        now, n = {a}, 0
        seen = set()
        while now:
            n += 1
            now = {y for x, y in edges if x in now} - seen
            seen |= now
            out |= {(a, b): n for b in now}
    return out


def test_reachable_pairs(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(36)} | {(100 + i, 101 + i) for i in range(14)} | {(7, 7)}
    df = spark.createDataFrame([*edges, *list(edges)[:5]], "a int, b int").unionAll(spark.createDataFrame([(None, 1), (2, None)], "a int, b int"))
    got = {(r.a, r.b): r.steps for r in reach.reachable(df, "a", "b").collect()}
    assert got == closure(edges)
    some = spark.createDataFrame([(100,), (7,), (100,)], "x int")
    assert {(r.a, r.b): r.steps for r in reach.reachable(df, "a", "b", some).collect()} == closure(edges, [100, 7])
    assert {(r.a, r.b) for r in reach.reachable(df, "a", "b", most=2).collect()} == {k for k, n in closure(edges).items() if n <= 2}
    assert reach.reachable(df.limit(0), "a", "b").collect() == []


def test_sketches_are_not_kept_for_each_distinct_value(spark):
    from tessera.plans import catalog

    plan = catalog.QUERIES["sketched_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    with_sketches = [line for line in plan.split("\n") if "Aggregate" in line and "approx_count_distinct(" in line]
    assert with_sketches and not any("(distinct l_partkey" in line for line in with_sketches)


def test_percentiles_keep_no_buffer_of_values(spark):
    from tessera.plans import catalog

    plan = catalog.QUERIES["percentiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
