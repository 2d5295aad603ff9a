"""Registered queries against their DuckDB SQL on the smallest tables, and their contracts' columns."""

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_crf_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_exact_digest": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op3_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op5_license_diagonals": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op6_kneser_ney_quality": {"doc_id", "perplexity", "kept"},
    "op7_minhash_neardup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op8_tool_calls": {"conv_id", "call_id", "status", "json"},
    "op9_url_rules": {"page_id", "host", "path", "rule", "verdict"},
    "op10_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op11_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


def test_every_operator_has_one_query():
    assert {n: n.split("_")[0] for n in queries.QUERIES} == {n: n.split("_")[0] for n in COLUMNS}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    con.sql("SET enable_progress_bar = false")
    for table in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS, key=lambda n: int(n.split("_")[0][2:])))
def test_columns_and_whole_table(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(out.columns)
    key = out.columns[0]
    source = {"conv_id": "conversations", "page_id": "pages"}.get(key, "documents")
    assert out.select(key).distinct().count() == queries.read(spark, DATA, source).select(key).distinct().count()
