"""The pipeline against a version that composes each stage's decisions from plain checks of its input."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_neardup import brute as duplicates
from tokenizers import Tokenizer

from tessera.llm import langid, quality

SYLLABLES = {"aa": ["th", "ing", "er", "on", "ly"], "bb": ["sch", "ung", "keit", "über", "ge"]}


def tables(path, spark):
    rng = random.Random(7)
    docs, labels = [], []
    items = [(i, " ".join("".join(rng.choices(SYLLABLES["aa"], k=3)) for _ in range(20))) for i in range(4)]
    common = {"aa": ["the", "of"], "bb": ["der", "und"]}
    for i in range(260):
        lang = rng.choice(["aa", "bb"])
        words = [rng.choice(common[lang]) if k % 2 else "".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for k in range(rng.randrange(20, 90))]
        good = int(rng.random() < 0.85)
        text = " ".join(words) if good else " ".join(w + "%%%" for w in words)
        if good and i % 29 == 3:
            text = items[i % 4][1] + " " + text
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, good, 0))
    docs += [(300 + i, docs[i][1], docs[i][2], "copy", docs[i][4]) for i in range(20)]
    docs += [(400, None, None, None, None), (401, "", "aa", "s", 0), (402, "12 34 !!", "aa", "s", 8)]
    shape = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, rows in (("documents", docs), ("labels", labels), ("benchmark", items)):
        spark.createDataFrame(rows, shape[name]).write.parquet(f"{path}/{name}.parquet")
    return items


def test_every_stage_on_its_input(spark, tmp_path):
    items = tables(tmp_path, spark)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    names, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], d))
    assert all(x.columns == names for x in seen[:-1])
    rows = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in seen[:-1]]

    judged = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert set(rows[1]) == {i for i in rows[0] if judged[i]} and 200 < len(rows[1]) < 270
    assert not any("%%%" in (t or "") for t in rows[1].values())

    model = langid.train(seen[1].filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    named = langid.Labeller(model).texts([*rows[1].values()])
    assert set(rows[2]) == {i for i, lang, score in zip(rows[1], named["lang"], named["score"], strict=True) if lang != "und" and score >= 0.5}

    assert set(rows[3]) == {i for i, (_, root) in duplicates(rows[2].items()).items() if root == i} and len(rows[3]) < len(rows[2])
    assert set(rows[4]) == {i for i, r in contaminated(rows[3].items(), items).items() if not r[4]} and len(rows[4]) < len(rows[3])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, d).collect()
    size, fill = defaultdict(int), defaultdict(int)
    for r in out:
        size[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert size == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows[4].items()}
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(size.values()) // 1024) + 1
    assert np.unique([*fill]).size == len(fill)


def test_empty_documents(spark, tmp_path):
    tables(tmp_path, spark)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
