"""Encoding and decoding against the library, on hostile texts, in and beyond the table."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import pieces, queries

DATA = "/root/testdata/sf0.001"
MODEL = queries.vocabulary(queries.PIECES)
SIGNS = ["a", "b", "e", "the", "  ", " ", "\t", "\n", "▁", "é", "你", "　", "\x00", "12", "😀", "́", "http://x.y/z", "A", "ing", "�", "<s>", "</s>", "<unk>", "<0x41>", "\x7f", "ﬁ", "​", "\x1c"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hostile(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("rows", [pieces.TABLE_ROWS, 20, 0])
def test_ids_and_texts_are_the_librarys(spark, library, rows):
    texts = [*hostile(1500), "", " ", "  ", "a ", " a", "▁", " " * 500, "a" * 20_000, "word " * 200_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    got = pieces.decode(pieces.encode(docs, MODEL, table_rows=rows), MODEL).orderBy("doc_id").collect()
    want = [[*x, library.eos_id()] for x in library.encode(texts)]
    assert [r.ids for r in got] == want
    assert [r.decoded for r in got] == library.decode(want)
    assert got[0].chunk == "x"


def test_any_ids_are_decoded(library):
    rng = random.Random(3)
    some = [*range(0, 300), *[library.piece_to_id(p) for p in ("▁", "▁▁", "▁a", "a", "the", "▁the")] * 40]
    lists = [[rng.choice(some) for _ in range(rng.randrange(12))] for _ in range(8000)]
    got = pieces.Decoder(pieces.checked(MODEL)).decode(np.array([x for ids in lists for x in ids], np.int32), np.array([len(ids) for ids in lists])).to_pylist()
    assert got == library.decode(lists)


def test_edges(spark, library):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x y"), (2, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in pieces.encode(docs, MODEL).collect()), key=repr)
    assert got == sorted([(1, None, [2]), (1, None, [2]), (None, "x y", [*library.encode("x y"), 2]), (2, "", [2])], key=repr)
    assert pieces.encode(docs.limit(0), MODEL).collect() == []
    lists = spark.createDataFrame([(None,), ([],), ([None, library.piece_to_id("▁a")],)], "ids array<int>")
    assert sorted(r.decoded for r in pieces.decode(lists, MODEL).collect()) == ["", "", "a"]
    with pytest.raises(ValueError):
        pieces.encode(docs, MODEL, out="TEXT")
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode(spark.createDataFrame([([40_000],)], "ids array<int>"), MODEL).collect()


def test_table_holds_what_occurs_most(spark):
    rows = spark.createDataFrame([(b" a", 9), (b" b", 4), (b" c", 3), (b" " + b"d" * 90, 50)], "chunk binary, n long")
    assert {bytes(r.chunk) for r in pieces.frequent(rows, 2).collect()} == {b" a", b" b"}
    assert pieces.frequent(rows, 0).collect() == []
    docs = spark.createDataFrame([("a  b a",), ("a",), (None,)], "text string")
    assert {bytes(r.chunk): r.n for r in pieces.counted(docs, "text").collect()} == {b" a": 3, b"  b": 1}


def test_query_is_the_library(spark, library):
    docs = {r.doc_id: r.text for r in queries.read(spark, DATA, "documents").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op12_sentencepiece(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = [*library.encode(docs[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert queries.op12_sentencepiece(spark, DATA).filter(F.col("n_tokens").isNull()).count() == 0
