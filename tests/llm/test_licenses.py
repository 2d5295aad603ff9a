"""License scans: base places against brute force, notices with edits, edges."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_base_places_match_brute_force(spark):
    rng = random.Random(6)
    bits = ["MIT", "license", "apache", "General", "public", "the", "of", "software", "is", "é"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randrange(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "mit"), (103, "x " * 5000 + "MIT-License"), (104, "mit license " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit(1), "size": F.lit("x"), "words": F.lit(2)})
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        w, places, labels = WORD.findall((text or "").replace("É", "é").lower()), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.score == 1 or not labels


def test_notices_with_left_out_and_added_words(spark):
    notice = licenses.NOTICES[0][0].split()
    changed = notice[:10] + notice[11:30] + ["really", "truly"] + notice[30:]
    half = notice[: len(notice) // 3]
    rows = [(1, "word " * 20 + " ".join(changed) + " word" * 20), (2, " ".join(half)), (3, "Licensed under CC BY-NC 4.0."), (4, " ".join(next(t for t, b in licenses.NOTICES if b == "bsd").split()[:-2]).upper()), (5, " ".join(notice[:30] + ["left"] * 12 + notice[30:])), (6, " ".join(notice[:30] + ["left"] * 50 + notice[30:])), (7, "licensed under licensed under cc by 4 0")]
    got = {r.doc_id: (r.labels, r.n_base) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 0), 2: ("", 0), 3: ("cc-by-nc", 0), 4: ("bsd", 0), 5: ("mit", 0), 6: ("", 0), 7: ("cc-by", 0)}


def test_notices_equal_brute_force(spark):
    rng = random.Random(8)
    notices = [(text, label) for text, label in licenses.NOTICES]
    rows = []
    for i in range(120):
        words = WORD.findall(rng.choice(notices)[0].lower())
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(0, 4)] = rng.choices([*words, "the", "of"], k=rng.randrange(0, 5))
        rows.append((i, " ".join(rng.choices(["the", "software", "of", "any"], k=rng.randrange(0, 30)) + words + words[: rng.randrange(0, len(words) + 1)])))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = 0
    for i, text in rows:
        w, labels, best = text.split(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            if f" {phrase} " in f" {text} ":
                labels, best = labels | {label}, 1.0
        for notice, label in notices:
            t = WORD.findall(notice.lower())
            k = 2 if len(t) < 12 else 3
            votes = [(p - q, q) for p in range(len(w) - k + 1) for q in range(len(t) - k + 1) if w[p : p + k] == t[q : q + k]]
            added = 0 if len(t) < 12 else int((1.34 - 1) * len(t))
            for d in {d for d, _ in votes}:
                score = len({q + x for e, q in votes if d <= e <= d + added for x in range(k)}) / len(t)
                best = max(best, score)
                if score >= (1 if len(t) < 12 else 0.75):
                    labels.add(label)
        some += bool(labels)
        assert (got[i].labels, got[i].score) == (",".join(sorted(labels)), best)
    assert 20 < some < 115


def test_phrases_of_one_word_and_without(spark):
    df = spark.createDataFrame([(1, "gpl x gpl"), (2, "gplx"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.last_word, r.labels) for r in licenses.scan(df, phrases=(("GPL", "gpl"), ("...", "none")), notices=(("one", "b"),)).collect()}
    assert got == {1: (2, 2, "gpl"), 2: (0, None, ""), 3: (0, None, "")}
    assert [r.labels for r in licenses.scan(df, phrases=(), notices=()).collect()] == [""] * 3


def test_empty_null_and_repeated(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = licenses.scan(spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_base) for r in rows) == [("1", 1), ("1", 1), ("None", 0)]
