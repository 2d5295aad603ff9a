"""Collocations against brute force: the stack over split ranges, scores, removal within longer phrases, edges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import phrases


def plain(rows, max_n=3, least=10, top=2000, share=50):
    f, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, max_n + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    found = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(100 * b >= share * a for (g, q), b in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, words[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


def texts(rng, n):
    words = ["the", "The", "of", "a", "cat", "x-y", "it's", "é", "Zé", "a\x01", "\x00", "z z", "你好"]
    ends = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!?"]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("max_n,least,share", [(3, 10, 50), (2, 3, 50), (4, 3, 80)])
def test_equal_brute_force(spark, max_n, least, share):
    rng = random.Random(max_n)
    rows = [(t, rng.choice(["en", "de", None, "x\ty"])) for t in texts(rng, 900)] + [("of the cat", "en")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    got = sorted(tuple(r) for r in phrases.collocations(docs, max_n=max_n, least=least, share=share).collect())
    want = plain(rows, max_n, least, share=share)
    assert got == want and len(want) > 20
    top = sorted(tuple(r) for r in phrases.collocations(docs, max_n=max_n, least=least, share=share, top=5).collect())
    assert top == plain(rows, max_n, least, 5, share)


def test_stack_over_any_cut_of_the_keys():
    """Ranges and batches may end anywhere: whole counts, and partial ones that sum to the rest."""
    rng, truth = random.Random(5), Counter()
    found = Counter((rng.choice("xy"), tuple(rng.choice("abc") for _ in range(rng.randrange(1, 4)))) for _ in range(400))
    for (lang, w), n in found.items():
        for d in range(len(w) + 1):
            truth[lang, w[:d]] += n
    keys = sorted(((lang, "".join(x + "\t" for x in w), n) for (lang, w), n in found.items()), reverse=True)
    for trial in range(60):
        cuts = sorted(rng.sample(range(1, len(keys)), trial % 9))
        got, least = Counter(), rng.choice([1, 6])
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            stack, at, out = phrases.Stack(3, least), a, []
            while at < b:
                to = min(b, at + rng.randrange(1, 9))
                lang, key, n = zip(*keys[at:to], strict=True)
                out.append(stack.push(pa.array(lang), pa.array(key), np.array(n)))
                at = to
            out.append(stack.end())
            whole = [r for batch in out for r in batch.to_pylist() if not r["partial"] and r["words"]]
            assert all(r["n"] == truth[r["lang"], tuple(r["phrase"].split())] for r in whole)
            assert len({(r["lang"], r["phrase"]) for r in whole}) == len(whole)
            for batch in out:
                for r in batch.to_pylist():
                    got[r["lang"], tuple(r["phrase"].split())] += r["n"]
        assert all(got[k] == n for k, n in truth.items() if n >= least or not k[1])


def test_exact_scores(spark):
    a, x, y = 3_037_000_500_123, 7_000_000_000_001, 9_999_999_999_999
    df = spark.createDataFrame([(a, x, y)], "a long, l long, r long")
    assert df.select(phrases.score(df.a, df.l, df.r)).first()[0] == 10**6 * a * a // (x * y)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "en", 1), ("", None, 2), (" \t.\n", "en", 3)], "text string, lang string, phrase int")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.limit(0)).collect() == []
    long = spark.createDataFrame([("big word " * 200_000, None, 1)], "text string, lang string, phrase int")
    got = [tuple(r) for r in phrases.collocations(long).collect()]
    assert got == plain([("big word " * 200_000, None)])
    assert phrases.combined([np.array([1 << 40, 1 << 40, 2]), np.array([1 << 30, 1 << 30, 0])])[1].tolist() == [1, 2]
    with pytest.raises(ValueError):
        phrases.collocations(docs, max_n=1)
