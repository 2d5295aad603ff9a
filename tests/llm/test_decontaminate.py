"""Decontamination against brute force over all windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, of = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    of |= windows[tuple(w[i : i + k])]
        ids = ",".join(sorted(str(i) for i in of if i is not None))
        out[doc] = (len(w), len(hit), len([i for i in of if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("index_rows", [200_000, 3])
def test_matches_brute_force(spark, index_rows):
    """The second bound takes the shuffle path."""
    rng = random.Random(4)
    vocabulary = ["the", "of", "Ü", "x1", *(f"w{i}" for i in range(40))]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, some(rng.choice([13, 14, 20, 30]))) for i in range(12)] + [(50, "Lone"), (51, "two words"), (52, None), (53, "!?"), (54, "a b a b a b a b a b a b a b a b"), (None, some(15))]
    items.append((90, items[0][1]))
    docs = [(1, None), (2, ""), (3, "lone"), (4, "Two  WORDS two words"), (5, "a b " * 30)]
    for i in range(40):
        w = some(rng.randrange(5, 60)).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w)) : 0] = rng.choice([t for _, t in items if t]).upper().split()
        docs.append((100 + i, ", ".join(w)))
    docs.append((900, some(4000) + " " + items[3][1] + " " + some(4000)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "key": F.lit("x")})
    its = spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(df, its, index_rows=index_rows).collect()}
    assert got == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    items = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    assert decontaminate.contamination(docs([]), items([(1, "a b")])).collect() == []
    assert [tuple(r)[:4] for r in decontaminate.contamination(docs([(1, "a b")]), items([])).collect()] == [(1, 2, 0, 0)]
    rows = decontaminate.contamination(docs([(1, "a b"), (1, "a b"), (None, "a b"), (1, "c")]), items([(1, "a b")])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in rows) == [("1", 1, 0), ("1", 2, 2), ("1", 2, 2), ("None", 2, 2)]


def test_contaminated_documents_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s"), (3, None, "s")], "doc_id long, text string, source string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


@pytest.mark.parametrize("index_rows", [200_000, 0])
def test_documents_without_id_are_hit_and_dropped(spark, index_rows):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "a b"), (1, "d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = decontaminate.contamination(docs, items, index_rows=index_rows).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [("1", 1, 0), ("1", 2, 2), ("None", 1, 0), ("None", 2, 2)]
    kept = decontaminate.drop_contaminated(docs, items, index_rows=index_rows)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "d"), ("None", "c")]
