"""Texts of a million characters, ties, repeated rows and clashing names through the operators, and through the whole pipeline."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact, licenses, neardup, packing, queries, tokencount, urlfilter

LONG = "some words of a long text " * 40_000
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG + PASSAGE), (2, LONG + PASSAGE), (3, None), (4, ""), (None, LONG), (5, "licensed under the apache license " + LONG)]
    named = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["words", "n", "pos", "key", "hi", "lo", "fp", "hash", "length", "task", "lang", "w"]
    return named.withColumns({c: F.lit(c) for c in clash})


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_digests(docs):
    out = by_id(exact.fingerprints(docs))
    assert len(out[2]) == 2 and out[1][0].n_chars == len(LONG) and out[1][0].fingerprint == out[None][0].fingerprint != out[2][0].fingerprint


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(9, PASSAGE), (9, PASSAGE), (None, PASSAGE), (10, None)], "item_id long, text string")
    out = by_id(decontaminate.contamination(docs, items))
    assert [(r.n_hit, r.n_items, r.contaminated) for r in out[2]] == [(13, 1, False)] * 2 and out[1][0].n_hit == 0 and out[2][0].n_words == 240_013


def test_token_counts(docs):
    out = by_id(tokencount.token_counts(docs, queries.vocabulary()))
    assert out[1][0].n_bytes == len(LONG) and out[1][0].n_tokens > 200_000 and out[3][0].n_tokens == out[4][0].n_tokens == 0


def test_licenses(docs):
    out = by_id(licenses.scan(docs))
    assert out[5][0].n_base == 1 and out[5][0].first_word == 3 and out[1][0].n_base == 0 and out[5][0].n_words == 240_005


def test_near_duplicates(docs):
    out = by_id(neardup.near_duplicates(docs))
    assert {i: out[i][0].component_id for i in (1, 2, 5)} == {1: 1, 2: 2, 5: 5} and out[1][0].n_shingles == 6


def test_packing(docs):
    out = by_id(packing.pack(docs, queries.vocabulary()))
    assert sum(r.length for r in out[1]) == sum(r.length for r in out[None]) > 200_000 and max(r.length for rows in out.values() for r in rows) == 1024


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://x.example.net/en/" + "a" * 1_000_000), (2, "no scheme"), (2, "no scheme"), (3, None)], "page_id long, url string").withColumn("host", F.lit(1))
    out = {r.page_id: r for r in urlfilter.judge_urls(pages).collect()}
    assert out[1].rule == "example.net/en/" and out[1].verdict == "allow" and len(out[1].path) == 1_000_004 and out[3].host == ""


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    """Names that the stages use themselves, in any case, pass through all stages but the last."""
    rows = [(i, f"the words of document number {i} are " + " ".join(f"word{i * j % 17}" for j in range(40)), "en", "s") for i in range(60)] + [(3, None, None, "s"), (None, "the words of a document", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["_good", "_score", "_quality", "_LANGUAGE", "_gone", "_copy", "_bad", "_bad_text", "good", "tokens", "fp", "of", "h"]
    docs = docs.withColumns({n: F.lit(n) for n in names})
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    left = docs.collect()
    assert 0 < len(left) <= 62 and all(r[n] == n for r in left for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(left)
