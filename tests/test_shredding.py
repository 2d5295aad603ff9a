"""Frequent paths of JSON, typed columns and the rest, and the way back."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import shredding

CHOSEN = [(["a"], "bigint"), (["b", "c"], "string"), (["b", "d"], "boolean"), (["x y"], "double")]


def made(rng):
    value = {}
    if rng.random() < 0.9:
        value["a"] = rng.choice([rng.randrange(100), rng.randrange(100), "one", None, [1, {"a": 2}]])
    if rng.random() < 0.9:
        value["b"] = rng.choice([{"c": "é\"q", "d": rng.random() < 0.5, "e": {"deep": 1}}, {"c": 5}, {}, 7])
    if rng.random() < 0.7:
        value["x y"] = rng.choice([0.5, 2.25, True])
    return value


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [json.dumps(made(rng)) for _ in range(300)] + [None, "not json", "[1, 2]", "3", "{}", "null"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, j string")


def test_counts_of_paths(docs):
    truth = Counter()
    kind = lambda v: "BOOLEAN" if isinstance(v, bool) else {int: "BIGINT", str: "STRING", dict: "OBJECT", list: "ARRAY", type(None): "VOID"}.get(type(v), "DECIMAL")

    def walk(value, path):
        for k, v in value.items() if isinstance(value, dict) and len(path) < 3 else ():
            truth[(*path, k), kind(v)] += 1
            walk(v, (*path, k))

    for r in docs.collect():
        try:
            walk(json.loads(r.j or ""), ())
        except ValueError:
            continue
    assert {(tuple(r.path), r.kind): r.n for r in shredding.paths(docs, "j").collect()} == truth
    assert (["a"], "bigint") in shredding.frequent(docs, "j", 0.2) and shredding.frequent(docs, "j", 0.99) == []


def test_typed_columns_and_the_way_back(docs):
    names = ["a", "c", "d", "x"]
    out = shredding.shred(docs, "j", CHOSEN, names)
    back = shredding.assembled(F.col("rest"), [(p, F.col(n)) for (p, _), n in zip(CHOSEN, names, strict=True)])
    for r in out.withColumn("back", back).withColumn("rest", F.to_json("rest")).collect():
        try:
            value = json.loads(r.j or "")
        except ValueError:
            assert (r.a, r.c, r.d, r.rest, r.back) == (None,) * 5
            continue
        assert json.loads(r.back) == value
        b = value.get("b") if isinstance(value, dict) else None
        a = value.get("a") if isinstance(value, dict) else None
        assert r.a == (a if type(a) is int else None)
        assert r.c == (b["c"] if isinstance(b, dict) and isinstance(b.get("c"), str) else None)
        assert r.d == (b["d"] if isinstance(b, dict) and isinstance(b.get("d"), bool) else None)
        if r.a is not None:
            assert "a" not in json.loads(r.rest)


def test_edges(docs):
    assert shredding.paths(docs.limit(0), "j").collect() == [] and shredding.shred(docs.limit(0), "j", CHOSEN, ["a", "c", "d", "x"]).collect() == []
    with pytest.raises(ValueError):
        shredding.shred(docs, "j", CHOSEN[:1], ["J"])
    with pytest.raises(ValueError):
        shredding.shred(docs, "j", CHOSEN[:2], ["a", "A"])
