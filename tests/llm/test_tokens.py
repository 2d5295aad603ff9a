"""Token counts and packing against the tokenizer's library and brute-force checks."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import encoder, packing, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["<|endoftext|>", "<|", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "a", "be", "Z", "é", "ß", "1", "23", "²", "!", "...", "\xa0", "　", "日本", "😀", "'S", " '", "\r\n", "\x1c", "_", "-", "ʼ", "՘", " ", "٣", "\x85", "\U0001c5e1"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def compiled():
    return tokencount.Compiled(PATH)


def texts(seed=3, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randrange(0, 30))) for _ in range(n)] + ["", "a" * 3000, "ab" * 300, " " * 3000, "!" * 700, "x'" * 500, "thing " * 2000]


def test_counts_and_ids_are_the_librarys(library, compiled):
    some = texts()
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert tokencount.Counter(compiled).counts(some).tolist() == [len(x) for x in want]
    ids, size = encoder.Encoder(compiled).encode(some, 2)
    cut = np.cumsum(size)
    assert [ids[b - n : b].tolist() for b, n in zip(cut, size, strict=True)] == [[*x, 2] for x in want]


def test_long_runs_and_characters_apart_are_the_librarys(library, compiled, monkeypatch):
    some = [" " * 2_000_000 + "x", "\n" * 300_000, "a" * 30_000, "x " + "!" * 20_000 + " y", "日本" * 9000]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    ids, size = encoder.Encoder(compiled).encode(some, 2)
    assert size.tolist() == [len(x) + 1 for x in want] and ids.tolist() == [i for x in want for i in (*x, 2)]
    monkeypatch.setattr(compiled, "apart", "é1")
    some = texts(11, 500)
    ids, _ = encoder.Encoder(compiled).encode(some, 2)
    assert ids.tolist() == [i for e in library.encode_batch(some, add_special_tokens=False) for i in (*e.ids, 2)]


def test_forgetting_changes_nothing(compiled, monkeypatch):
    some = texts(5, 300)
    want = tokencount.Counter(compiled).counts(some).tolist()
    monkeypatch.setattr(tokencount, "ARCS", 10)
    machine = tokencount.Counter(compiled)
    assert [int(machine.counts([t])[0]) for t in some] == want


def test_counts_compose_over_short_chunks(library, compiled, monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", 4)
    some = texts(7, 1500)[:1500] + ["don't we'll 've'd x'", "it's" * 40]
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert tokencount.Counter(compiled).counts(some).tolist() == want


def test_chunk_maps_equal_a_sequential_run(compiled):
    machine = tokencount.Counter(compiled)
    symbol = np.random.default_rng(1).integers(0, 6, 1000).astype(np.uint8)
    state, want = tokencount.FRESH, []
    for s in symbol:
        want.append(bool(machine.begins[state * 9 + s]))
        state = machine.next[state * 9 + s]
    assert machine.boundaries(symbol).tolist() == want


def test_query_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "x " * 600), (None, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1))
    got = sorted(map(tuple, tokencount.token_counts(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want, key=str)
    assert tokencount.token_counts(df.limit(0), PATH).collect() == []


def test_packing_covers_every_document(spark, library):
    rng = random.Random(2)
    rows = [(i, "thing of " * rng.randrange(0, 700)) for i in range(60)] + [(1, "thing"), (None, None), (70, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "task": F.lit(1)})
    out = packing.pack(df.repartition(3), PATH, capacity=64).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:i]) for i in range(len(group))]
        assert sum(r.length for r in group) <= 64
    assert sorted(by) == list(range(len(by)))
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 64 or 64
        for piece, start in enumerate([0, *range(head, len(ids), 64)]):
            part = ids[start : start + (head if piece == 0 else 64)]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert len(by) <= -(-sum(r.length for r in out) // 64) + 1
    assert packing.pack(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_local_search_keeps_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = Counter(rng.integers(*[(1, 100), (26, 50), (30, 70), (20, 60)][seed], 400).tolist())
    first = packing.best_fit(lengths, 100)
    then = packing.local_search(first, 100)
    held = Counter()
    for pattern, many in then.items():
        assert sum(pattern) <= 100
        for x in pattern:
            held[x] += many
    assert held == lengths and sum(then.values()) <= sum(first.values())
    square = lambda bins: sum(sum(p) ** 2 * m for p, m in bins.items())
    assert square(then) >= square(first)
    ranks = Counter()
    for length, low, high, _, _ in packing.seats(then):
        assert low == ranks[length]
        ranks[length] = high + 1
    assert ranks == lengths


def test_local_search_empties_bins_that_best_fit_leaves():
    lengths = Counter(np.random.default_rng(0).integers(260, 500, 3000).tolist())
    first = packing.best_fit(lengths, 1024)
    assert sum(packing.local_search(first, 1024).values()) <= 0.98 * sum(first.values())


@pytest.mark.parametrize("n", [60, 6_000_000])
def test_local_search_ends_by_itself_at_any_size(n):
    then = packing.local_search(packing.best_fit({400: n, 312: 2 * n}, 1024), 1024)
    assert then == {(400, 312, 312): n}
