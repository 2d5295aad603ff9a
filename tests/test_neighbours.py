"""Nearest neighbours against brute force: recall, candidates, exact similarities, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours
from tessera.plans import catalog

DATA = "/root/testdata/sf0.01"


def brute(x, ids, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[asked] @ unit.T
    out = {}
    for row, q in zip(s, asked, strict=True):
        row[q] = -9
        out[ids[q]] = [ids[i] for i in np.argsort(-row, kind="stable")[:k]]
    return out


def test_recall_on_the_table(spark):
    rows = sorted(spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    true = brute(x, ids, [i for i, v in enumerate(ids) if v % 50 == 0], 10)
    got = catalog.QUERIES["nearest_neighbours"](spark, DATA).collect()
    found = {q: {r.neighbour for r in got if r.query == q} for q in true}
    assert np.mean([len(found[q] & set(true[q])) / 10 for q in true]) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for r in got:
        a, b = x[place[r.query]], x[place[r.neighbour]]
        assert r.similarity == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=2e-6)
    assert len({(r.query, r.neighbour) for r in got}) == len(got) == 10 * len(true)
    assert all([r.similarity for r in sorted(own, key=lambda r: r.rank)] == sorted((r.similarity for r in own), reverse=True) for own in ([r for r in got if r.query == q] for q in true))


def test_clustered_vectors_need_few_candidates(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 16))
    x = np.repeat(centres, 20, axis=0) + 0.15 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    some, shape = df.filter("id % 50 = 0"), {"size": 16, "tables": 5, "bits": 10, "probes": 12}
    true = brute(x, list(range(3000)), list(range(0, 3000, 50)), 10)
    found = {}
    for r in neighbours.nearest(some, df, "id", "v", 10, **shape).collect():
        found.setdefault(r.query, set()).add(r.neighbour)
    assert np.mean([len(found[q] & set(true[q])) / 10 for q in true]) >= 0.95
    assert neighbours.candidates(some, df, "v", **shape) < 0.16 * 60 * 3000  # repeats in several tables included


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id int, v array<float>").withColumn("t", F.lit(1))
    got = sorted((r.query, r["rank"], r.neighbour) for r in neighbours.nearest(df, df, "id", "v", 3, 2, tables=3, bits=2, probes=4).collect())
    assert got == [(1, 1, 2), (1, 2, 8), (1, 3, 7), (2, 1, 8), (2, 2, 1), (2, 3, 7), (7, 1, 2), (7, 2, 8), (7, 3, 1), (8, 1, 2), (8, 2, 1), (8, 3, 7)]
    assert neighbours.nearest(df, df.limit(0), "id", "v", 3, 2).collect() == [] and neighbours.nearest(df.limit(0), df, "id", "v", 3, 2).collect() == []


def test_pieces_of_a_hot_bucket(spark, monkeypatch):
    """Copies of one vector, and others, in pieces of few rows: the same neighbours as by brute force, ties by id; no join of pairs."""
    monkeypatch.setattr(neighbours, "ROWS", 7)
    monkeypatch.setattr(neighbours, "AT_ONCE", 3)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 60, axis=0), rng.normal(size=(90, 8))]).astype(np.float32)
    rows = [(f"n{i:03}", v.tolist()) for i, v in enumerate(x)] + [("nan", [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(5)
    found = neighbours.nearest(df, df, "id", "v", 4, 8, tables=2, bits=1, probes=2)  # all pairs are candidates
    got = {(r.query, r["rank"]): (r.neighbour, r.similarity) for r in found.collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    assert len(got) == 4 * len(x)
    for i in range(len(x)):
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:4]
        assert [got[f"n{i:03}", r][0] for r in (1, 2, 3, 4)] == [f"n{j:03}" for j in want]
        assert [got[f"n{i:03}", r][1] for r in (1, 2, 3, 4)] == pytest.approx([s[i, j] for j in want])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan.split("FlatMapCoGroups")[0] and "SortMergeJoin" not in plan
