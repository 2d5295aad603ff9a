"""Near-duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, neardup


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e")]
    base = [word() for _ in range(200)]
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            text[rng.randrange(200)] = word()
        rows.append((100 + i, " ".join(text)))
    rows += [(300 + i, " ".join(word() for _ in range(40))) for i in range(30)]
    rows += [(400 + i, rows[20][1]) for i in range(20)]
    rows.append((500, " ".join(["x"] * 5000)))
    return rows


@pytest.mark.parametrize("bound", [3_000_000, 1000])
def test_components_match_brute_force(spark, bound):
    """The second bound sends groups through their rarest shingles and the block path."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, group_shingles=bound).collect()}
    assert got == brute(rows)


def boilerplate(documents, seed=5):
    """Documents that share 46 of 100 words, at a similarity of 0.3; every tenth has a near copy, and one text has many."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = [word() for _ in range(48)]
    rows = []
    for i in range(documents):
        own = common + [word() for _ in range(52)]
        rows.append((10 * i, " ".join(own)))
        if i % 10 == 0:
            own[60 + i % 30] = word()
            rows.append((10 * i + 1, " ".join(own)))
    base = rows[0][1].split()
    for i in range(documents // 10):
        base[-1 - i % 3] = word()
        rows.append((10 * documents + i, " ".join(base)))
    return rows


def test_boilerplate_parts_without_blocks(spark, monkeypatch):
    """A group ten times the bound, in which no document is like most others: what remains together fits the bound."""
    rows = boilerplate(400)
    expected = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def no_blocks(*_):
        raise AssertionError("blocks were needed")

    monkeypatch.setattr(neardup, "link_blocks", no_blocks)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, group_shingles=4500).collect()}
    assert got == expected


def test_meetings_of_linked_sets_and_repeated_ids(spark):
    """Each linked pair of sets is in one part, whatever the percentage; one id may have two sets."""
    rng = random.Random(3)
    sets = {}
    for i in range(120):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.7 else frozenset(rng.sample(range(3000), rng.randint(1, 40)))
        sets[i] = frozenset(x if rng.random() < 0.93 else rng.randrange(3000) for x in base)
    rows = [(i % 2, i if i < 118 else 7, i, len(s), sorted(s)) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "gid long, doc_id long, sid long, n_shingles long, shingles array<long>")
    for percent in (50, 75, 100):
        part = {r.doc_id: r.gid for r in neardup.meetings(df, percent).collect()}
        for a, b in itertools.combinations(rows, 2):
            both = len(set(a[4]) & set(b[4]))
            if a[0] == b[0] and a[1] != b[1] and 100 * both >= percent * (a[3] + b[3] - both):
                assert part[a[1]] == part[b[1]]


def test_empty_null_ids_and_repeated_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)


def test_keep_one_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, None, "z")], "doc_id long, text string, root string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 3]
    assert neardup.keep_one(df).columns == df.columns
    again = df.unionByName(df).unionByName(spark.createDataFrame([(3, "other", "z"), (None, "q", "z"), (None, "q", "z")], df.schema))
    assert sorted((r.doc_id or 0, r.text or "") for r in neardup.keep_one(again).collect()) == [(0, "q"), (0, "q"), (1, "a b c d e f"), (3, ""), (3, "other")]
    assert neardup.keep_one(again).columns == df.columns


def test_components_of_chains_loops_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (500, 500), (3, 2)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {500: 500}


def test_tensored_keys_are_shared_by_equal_sets_only():
    value, begin = neardup.shingle_sets(["a b c d e f g", "a b c d e f g", "h i j k l m n"], 5, neardup.WordHashes())
    keys = neardup.Banding(10, 2).keys(value, begin)
    assert (keys[0] == keys[1]).all() and not np.isin(keys[0], keys[2]).any()
    assert len(set(keys[0].tolist())) == 100
