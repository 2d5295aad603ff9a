"""The conditional random field against sequential recursions and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid

SYLLABLES = {"aa": ["th", "ing", "er", "on", "ly"], "bb": ["sch", "ung", "keit", "über", "ge"], "cc": ["ción", "mente", "ar", "os", "ñ"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(1)
    return [(i, text(rng, lang := rng.choice([*SYLLABLES]), rng.randrange(5, 60)), lang) for i in range(n)]


def test_marginals_equal_the_recursion():
    rng = np.random.default_rng(0)
    count = np.array([1, 5, 70, 33, 32, 64, 300])
    emission, trans = rng.normal(size=(count.sum(), 3)) * 4, rng.normal(size=(3, 3))
    got, at = langid.marginals(emission, trans, count), 0
    for n in count:
        e, t = np.exp(emission[at : at + n]), np.exp(trans)
        a, forward = np.ones(3) / 3, np.zeros((n, 3))
        for i in range(n):
            a = (a @ t if i else a) * e[i]
            a /= a.sum()
            forward[i] = a
        b = np.ones(3)
        for i in range(n - 1, -1, -1):
            m = forward[i] * b
            assert abs(m / m.sum() - got[at + i]).max() < 1e-4
            b = t @ (e[i] * b)
            b /= b.sum()
        at += n


def by_enumeration(emission, trans, count):
    """Logarithm of the sum over all labellings, probabilities of labels, and of neighbouring pairs summed over all steps."""
    labels, at, log_sum, single, pairs = len(trans), 0, 0.0, [], np.zeros_like(trans)
    for n in count:
        ways = np.array(list(itertools.product(range(labels), repeat=n)))
        score = sum(emission[at + i, ways[:, i]] for i in range(n)) + sum(trans[ways[:, i - 1], ways[:, i]] for i in range(1, n))
        log_sum += np.log(np.exp(score).sum())
        p = np.exp(score) / np.exp(score).sum()
        single += [np.bincount(ways[:, i], p, labels) for i in range(n)]
        for i in range(1, n):
            np.add.at(pairs, (ways[:, i - 1], ways[:, i]), p)
        at += n
    return log_sum, np.array(single), pairs


def test_pairs_equal_the_enumeration_and_gradient_the_differences(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rng = np.random.default_rng(2)
    count = np.array([8, 1, 5, 3, 7])
    emission, trans = rng.normal(size=(count.sum(), 3)) * 2, rng.normal(size=(3, 3))
    first = np.zeros(count.sum(), bool)
    first[np.cumsum(count) - count] = True
    inner = np.flatnonzero(~first)
    log_sum, single, pairs = by_enumeration(emission, trans, count)
    forward, backward = langid.messages(emission, trans, count)
    got = langid.expected_pairs(forward, backward, emission, trans, inner)
    assert abs(langid.marginals(emission, trans, count) - single).max() < 1e-5 and abs(got - pairs).max() < 1e-4
    gold = rng.integers(3, size=count.sum())
    right = np.zeros((3, 3))
    np.add.at(right, (gold[inner - 1], gold[inner]), 1)

    def likelihood(e, t):
        return e[np.arange(len(gold)), gold].sum() + t[gold[inner - 1], gold[inner]].sum() - by_enumeration(e, t, count)[0]

    for i, j in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        assert abs((likelihood(emission, trans + step) - likelihood(emission, trans - step)) / 2e-5 - (right - got)[i, j]) < 1e-3
    for at, k in ((0, 1), (9, 2), (20, 0)):
        step = np.zeros_like(emission)
        step[at, k] = 1e-5
        slope = (np.eye(3)[gold] - single)[at, k]
        assert abs((likelihood(emission + step, trans) - likelihood(emission - step, trans)) / 2e-5 - slope) < 1e-3


def test_learned_transitions_follow_the_switches():
    rng = random.Random(3)
    windows = [(lang, text(rng, lang, 24).split()) for lang in SYLLABLES for _ in range(40)]
    model = langid.fit(windows)
    assert all(model.trans[i, i] > model.trans[i, j] + 0.1 for i in range(3) for j in range(3) if i != j)


def test_held_out_accuracy_and_edges(spark):
    rows = [*corpus(), (1000, None, "aa"), (1001, "", "bb"), (1002, "12 ²!", "cc"), (1003, "thing erly", None), (None, "thing", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"language": F.lit(1), "h": F.lit("x")})
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    apart = [(r, lang) for i, _, lang in corpus() if (r := got[i]).held_out]
    assert len(apart) > 30 and sum(r.lang_pred == lang for r, lang in apart) >= 0.95 * len(apart)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and 0 < got[1003].score <= 1


def test_words_of_mixed_texts(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    labeller = langid.Labeller(langid.train(df))
    rng = random.Random(9)
    first, last = text(rng, "aa", 15), text(rng, "bb", 15)
    parts, m = labeller.words([first + " " + last])
    named = [labeller.model.labels[k] for k in m.argmax(axis=1)]
    assert named[:13] == ["aa"] * 13 and named[-13:] == ["bb"] * 13


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(df).collect()] == ["und"]
    assert langid.predict(df.limit(0)).collect() == []


def test_filter_keeps_columns(spark):
    df = spark.createDataFrame([*corpus(), (999, "", "aa")], "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    kept = langid.keep_known(df, langid.train(df))
    assert kept.columns == df.columns and 999 not in {r.doc_id for r in kept.collect()}


def test_sample_is_bounded_whatever_repeats(spark):
    """One id on many rows, and one document on many rows, don't outgrow the bound."""
    rng = random.Random(8)
    rows = [(7, text(rng, "aa", 200), "aa") for _ in range(500)] + [(9, "ere on ly", "bb")] * 500 + [(i, text(rng, "cc", 5), "cc") for i in range(30)] + [(1, None, "cc"), (None, "x y", "cc"), (2, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, 10, 3, 24)
    n = {k: sum(lang == k for lang, _ in got) for k in ("aa", "bb", "cc")}
    assert n["aa"] <= 30 and n["bb"] == 1 and n["cc"] == 10 and max(len(run) for _, run in got) <= 24
    assert got == langid.sample(docs.repartition(5), 10, 3, 24)
    assert {lang for lang, _ in langid.sample(docs, 10, 3, 24, languages=2)} == {"aa", "bb"}
    assert langid.sample(docs.limit(0), 10, 3, 24) == []


def test_ties_empty_and_very_long_texts(spark):
    docs = spark.createDataFrame([*corpus(), (900, "ing ung " * 130_000, None), (901, "", None), (902, None, "aa"), (903, " 12 \n", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert len(out) == 244 and out[900].n_words == 260_000 and 0 <= out[900].score <= 1
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (901, 902, 903))
    assert langid.train(docs.filter("doc_id < 900")).labels == ["aa", "bb", "cc"]  # equal shares go to the first
