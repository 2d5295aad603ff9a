"""The Kneser-Ney model against a plain version of all of it, and what it keeps."""

import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ngrams, quality

START, REPEAT = 50257, 50258


def plain_model(counts, size):
    """Probability of c after b by the formulas of interpolated modified Kneser-Ney; counts: {(b, c): n}."""

    def cut(values):
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True)]

    off = lambda d, n: d[min(n, 3) - 1] if n else 0
    single = Counter(c for _, c in counts)
    d2, d1 = cut(counts.values()), cut(single.values())
    total1 = sum(single.values())
    after = defaultdict(dict)
    for (b, c), n in counts.items():
        after[b][c] = n

    def p(b, c):
        p1 = (single[c] - off(d1, single[c])) / total1 + sum(off(d1, n) for n in single.values()) / total1 / size
        if b not in after:
            return p1
        t = sum(after[b].values())
        n = after[b].get(c, 0)
        return (n - off(d2, n)) / t + sum(off(d2, m) for m in after[b].values()) / t * p1

    return p


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def words():
    return quality.vocabulary(None)


def plain_bigrams(library, text):
    out, before, last = [], START, None
    for k, segment in enumerate(re.split(r" (?=\S)", text or "") if (text or "").strip() else []):
        segment = " " + segment if k else segment
        ids = library.encode(segment, add_special_tokens=False).ids
        if segment == last:
            out.append((before, REPEAT))
        else:
            for i in ids:
                out.append((before, i))
                before = i
        before, last = ids[-1] if ids else before, segment
    return out


def test_model_equals_the_formulas(spark, words):
    rng = random.Random(3)
    counts = Counter((rng.randrange(4), min(rng.randrange(9), rng.randrange(9))) for _ in range(200))
    df = spark.createDataFrame([(0, *k, n) for k, n in counts.items()], "f int, b int, c int, n long")
    every = spark.createDataFrame([(0, b, c) for b in range(6) for c in range(9)], "f int, b int, c int")
    p, model = plain_model(counts, 9), ngrams.Model(df, 9)
    assert all(abs(sum(p(b, c) for c in range(9)) - 1) < 1e-9 for b in range(6))
    tables = ngrams.Tables(model, words)
    import numpy as np

    for r in model.probability(every).collect():
        assert abs(r.p / ngrams.SCALE - math.log(p(r.b, r.c))) <= 1.01 / ngrams.SCALE  # two roundings
        assert tables.logarithms(np.array([0]), np.array([r.b]), np.array([r.c]))[0] == r.p


def test_counts_cover_all_trusted_text(spark, library, words):
    texts = ["The cat, the dog.", None, "", " \n ", "the the the cat", "a  b\tb b b <|endoftext|> x", "é é", " lead lead"]
    df = spark.createDataFrame([(0, t) for t in texts], "f int, text string").repartition(3)
    got = {(r.b, r.c): r.n for r in ngrams.counts(df, words).collect()}
    assert got == Counter(x for t in texts for x in plain_bigrams(library, t))
    assert sum(n for (_, c), n in got.items() if c == REPEAT) == 3


def corpus(seed=5):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to"], ["".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 9))) for _ in range(300)]
    good = lambda n: " ".join(rng.choice(common if i % 2 else rare) for i in range(n)) + "."
    bad = [lambda n: " ".join([rng.choice(rare)] * n), lambda n: " ".join(rng.choice(rare) + "%%%" for _ in range(n)), lambda n: " | ".join(rng.choices(rare, k=n))]
    rows, labels = [], []
    for i in range(400):
        q = int(rng.random() < 0.8)
        rows.append((i, good(rng.randrange(30, 200)) if q else rng.choice(bad)(rng.randrange(30, 200)), "aa" if i % 2 else "bb"))
        if i % 4:
            labels.append((i, q, int(rng.random() < 0.1)))
    return rows, labels


def test_everything_equals_a_plain_version(spark, library):
    rows, labels = corpus(9)
    rows += [(500, None, "aa"), (501, "new words", None), (502, rows[0][1], "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    halves = {r.doc_id: r.h for r in df.select("doc_id", ngrams.half(F.col("text")).alias("h")).collect()}
    trusted = {i for i, q, t in labels if q and not t}
    pairs = {i: plain_bigrams(library, t) for i, t, _ in rows}
    size = REPEAT
    models = [plain_model(Counter(x for i in trusted if halves[i] != h for x in pairs[i]), size) for h in (0, 1)]
    lost = {i: [-math.log(models[halves[i]](*x)) for x in pairs[i]] for i in pairs}
    mean = {i: sum(v) / len(v) for i, v in lost.items() if v}
    var = {i: sum((x - mean[i]) ** 2 for x in lost[i]) / len(lost[i]) for i in mean}
    nth = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    bounds = {}
    for lang in ("aa", "bb", None):
        of = [i for i, _, x in rows if i in trusted and (lang is None or x == lang)]
        centre = nth([mean[i] for i in of], 0.5)
        n = {i: len(lost[i]) for i in of}
        within = sum(var[i] * n[i] for i in of) / sum(n.values())
        weight = {i: math.sqrt(n[i]) for i in of}
        between = max(sum(weight[i] * ((mean[i] - centre) ** 2 - within / n[i]) for i in of) / sum(weight.values()), 1e-6)
        z = [(mean[i] - centre) / math.sqrt(between + within / n[i]) for i in of]
        a, b = nth(z, 0.002), nth(z, 0.998)
        bounds[lang] = (centre, within, between, a - 0.25 * (b - a), b + 0.25 * (b - a))
    for table_rows in (ngrams.TABLE_ROWS, 0):  # by arrays, and by joins
        got = {r.doc_id: r for r in quality.classify(df, marks, table_rows=table_rows).collect()}
        assert len(got) == len(rows)
        for i, _, lang in rows:
            r = got[i]
            assert r.n_tokens == len(lost[i])
            if i not in mean:
                assert r.perplexity is None and not r.kept
                continue
            centre, within, between, a, b = bounds.get(lang, bounds[None])
            sd = math.sqrt(between + within / len(lost[i]))
            for ours, theirs in ((r.perplexity, mean[i]), (r.low, centre + a * sd), (r.high, centre + b * sd)):
                assert abs(math.log(ours) - theirs) < 1e-4
            assert r.kept == (r.low <= r.perplexity <= r.high)


def test_junk_goes_and_the_rest_stays(spark):
    rows, labels = corpus()
    truth = {i for i, t, _ in rows if t.endswith(".") and "%" not in t}
    rows += [(900, None, "aa"), (901, "", None), (902, rows[min(truth)][1], None), (903, rows[min(truth)][1], "zz"), (904, " \n\t ", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"s": F.lit(1), "_lang": F.lit("x"), "_quality": F.lit(2)})
    marks = spark.createDataFrame([*labels, (0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = {r.doc_id: r for r in quality.classify(df, marks).collect()}
    assert len(got) == len(rows)
    junk = [i for i, _, _ in rows if i < 900 and i not in truth]
    assert sum(got[i].kept for i in truth) >= 0.98 * len(truth) and not any(got[i].kept for i in junk)
    assert not any(got[i].kept for i in (900, 901, 904)) and got[900].perplexity is None
    assert got[902].kept and got[903].kept and math.isclose(got[902].perplexity, got[min(truth)].perplexity)
    kept = quality.keep_good(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got.values())
    by_joins = quality.keep_good(df, marks, table_rows=0)
    assert by_joins.columns == df.columns and sorted(r.doc_id for r in by_joins.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_without_trusted_text(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, " ", "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality.classify(df, none).collect()} == {1: True, 2: False}
    assert {r.doc_id: r.kept for r in quality.classify(df, none, table_rows=0).collect()} == {1: True, 2: False}
    assert quality.classify(df.limit(0), none).collect() == []


def test_shuffled_words_are_junk_and_every_text_is_held_out(spark):
    rng = random.Random(11)
    common, rare = (["".join(rng.choices("aeioulmnrst", k=6)) for _ in range(n)] for n in (160, 500))
    partner = dict(zip(rare, rng.sample(rare, len(rare)), strict=True))

    def text(second):
        return " ".join(f"{rng.choice(common)} {x} {second(x)}" for x in rng.choices(rare, k=50))

    rows = [(i, text(partner.get), "aa") for i in range(200)] + [(200 + i, text(lambda x: "".join(rng.sample(x, len(x)))), "aa") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, marks).collect()}
    assert sum(got[i].kept for i in range(200)) >= 198 and not any(got[i].kept for i in range(200, 240))
    mean = lambda ids: sum(math.log(got[i].perplexity) for i in ids) / len(ids)
    assert abs(mean(range(150)) - mean(range(150, 200))) < 0.1  # texts that are trusted are not likelier


def test_table_and_joins_give_equal_rows(spark):
    """Whatever the number of bigrams, to the last bit; copies, empty and very long texts too."""
    rows, labels = corpus(4)
    rows += [(600 + i, rows[0][1], "cc") for i in range(5)] + [(700, "the " + "word and " * 130_000, "aa"), (701, None, "aa"), (702, " ", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, tokens int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = (sorted((tuple(r) for r in quality.classify(docs, marks, table_rows=n).collect()), key=repr) for n in (10**6, 0))
    assert one == two and len(one) == len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one, two = (sorted((tuple(r) for r in quality.classify(docs, none, table_rows=n).collect()), key=repr) for n in (10**6, -1))
    assert one == two and all(r[3] is None for r in one)
    kept = [sorted(r.doc_id for r in quality.keep_good(docs, marks, table_rows=n).collect()) for n in (10**6, 0)]
    assert kept[0] == kept[1]
