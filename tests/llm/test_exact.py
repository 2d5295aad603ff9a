"""Exact digests against Python's own folding and hashing."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact


def canonical(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"[\s\x85]+", " ", text).strip(" ")


def check(spark, rows, count, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("guest", F.lit("x")).withColumn("mark", F.lit(1))
    got = {r.doc_id: r for r in exact.fingerprints(df, count=count, **settings).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    names = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canonical(text) == canonical(edited))
        assert r.near_next == float(canonical(text) == canonical(after))
        for form, name in ((canonical(text), r.fingerprint), (canonical(edited), r.edited_fingerprint)):
            assert names.setdefault(form, name) == name
    assert len(set(names.values())) == len(names)
    return got


ROWS = [(5, "Straße  ﬁn"), (9, "STRASSE fin "), (12, None), (13, ""), (14, "\t\n"), (20, "É"), (21, "é"), (22, "Ａ①"), (23, "a1"), (40, "long " * 3000), (41, "long " * 3000), (60, "ab"), (1 << 60, "abc"), (-7, "😀😀😀x")]


@pytest.mark.parametrize("count", [1, 3, 50])
def test_matches_python(spark, count):
    check(spark, ROWS, count)


def test_colliding_digests_are_told_apart(spark):
    """With a digest of the length alone, buckets hold different bytes."""
    poor = lambda canon: F.struct(F.length(canon).cast("long").alias("h"), F.lit(0).cast("long").alias("l"))
    got = check(spark, ROWS, 3, digest_of=poor)
    assert "-" in got[22].fingerprint and got[5].fingerprint == got[9].fingerprint


def test_empty_lone_null_and_repeated(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert exact.fingerprints(make([])).collect() == []
    (one,) = exact.fingerprints(make([(3, "abcdef")])).collect()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abcdab").hexdigest(), 1.0)
    assert len(exact.fingerprints(make([(None, "abc"), (None, "def")])).collect()) == 2
    rows = exact.fingerprints(make([(1, "abc"), (1, "abc"), (2, "xyz"), (None, "q")]), count=2).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
