"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white-space markers and what follows it up to the next
marker. Where no piece has a marker after another character (checked; an error
otherwise), no piece crosses from one chunk to the next, so a text's ids are
those of its chunks, end to end.

The distinct chunks of all texts are counted (each task combines its own before
the shuffle), and those that occur most are segmented once, by the library, in a
table of bounded size that goes to the workers. There the chunks of a batch of
texts are numbered, looked up in the table, and their ids are gathered by
position. A chunk too rare for the table is segmented once in each batch that
has it; a join by position in its place would shuffle every text. So nothing but
chunk counts is shuffled, and a worker holds the table and about a million
characters or one text.

Decoding is the same over chunks of ids that begin where a piece begins with a
marker. The first chunk loses its marker, so it is decoded as a beginning.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, save, ship
from .encoder import spans

MARK = "▁"
#: Rows of the table that goes to the workers at most, and bytes of a chunk in it: with ids, some 20 MB.
TABLE_ROWS, TABLE_BYTES = 300_000, 64
#: Distinct chunks that a task holds before it hands their counts on.
HELD = 500_000


@functools.lru_cache(2)
def library(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def checked(path: str) -> bytes:
    """The model's bytes; an error if its pieces cross white space, or it doesn't take texts as they are."""
    model = Path(path).read_bytes()
    sp = library(model)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("a piece has a white-space marker after another character: chunks aren't independent")
    probe = " ﬁ  Ａ①é　\t "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model changes texts before it segments them")
    return model


class Chunks:
    """The chunks of texts, end to end: `text` has each one's text, `slot` its number among the `distinct` ones (bytes, markers as spaces)."""

    def __init__(self, texts: list[str]):
        raw = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        last = np.cumsum(size)
        space = data == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[(last - size)[size > 0]] = True
        start = np.flatnonzero(opens)
        self.text = np.searchsorted(last, start, "right")
        offsets = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(data.tobytes())]).dictionary_encode()
        self.slot, self.distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()


def segment(sp: sentencepiece.SentencePieceProcessor, found: list[bytes]) -> list[list[int]]:
    """Ids of chunks. The library puts a marker before a text, so it gets them without their first; a marker alone is its piece's."""
    ids = sp.encode([c[1:].decode() for c in found], num_threads=1)
    for i, c in enumerate(found):
        if len(c) == 1:
            ids[i] = [sp.piece_to_id(MARK)]
    return ids


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(chunk, n): how often each chunk occurs in all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["chunk", "n"])
            held.clear()
            return made

        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                c = Chunks(part)
                for chunk, n in zip(c.distinct, np.bincount(c.slot, minlength=len(c.distinct)).tolist(), strict=True):
                    held[chunk] = held.get(chunk, 0) + n
                if len(held) > HELD:
                    yield out()
        yield out()
        release()

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, rows: int) -> DataFrame:
    """The chunks of counts (saved) that occur at least so often (a power of two) that they are at most so many."""
    short = counts.filter(F.length("chunk") <= TABLE_BYTES)
    steps = [1 << k for k in range(62)]
    have = short.agg(*[F.count(F.when(F.col("n") >= s, 1)) for s in steps]).first()
    least = next((s for s, n in zip(steps, have, strict=True) if n <= rows), steps[-1])
    return short.filter(F.col("n") >= least)


def segmented(counts: DataFrame, sent) -> DataFrame:
    """(chunk, ids) of counts: each chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(segment(library(sent.value), found), pa.list_(pa.int32()))], ["chunk", "ids"])
        release()

    return counts.select("chunk").mapInArrow(run, "chunk binary, ids array<int>")


class Table:
    """Distinct chunks and their ids, as arrays. Those that it lacks are segmented for a batch."""

    def __init__(self, rows: pa.Table):
        self.chunks = rows.column("chunk").to_pylist()
        lists = rows.column("ids").combine_chunks()
        self.ids, self.size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size

    @functools.cached_property
    def place(self) -> dict[bytes, int]:
        return {c: i for i, c in enumerate(self.chunks)}

    def encode(self, sp: sentencepiece.SentencePieceProcessor, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        c = Chunks(texts)
        place = self.place
        at = np.fromiter((place.get(x, -1) for x in c.distinct), np.int64, len(c.distinct))
        rare = np.flatnonzero(at < 0)
        own = segment(sp, [c.distinct[i] for i in rare.tolist()])
        width = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.concatenate([self.ids, np.fromiter((x for ids in own for x in ids), np.int32, int(width.sum()))])
        size, begin = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        size[rare], begin[rare] = width, len(self.ids) + np.cumsum(width) - width
        known = at >= 0
        size[known], begin[known] = self.size[at[known]], self.begin[at[known]]
        each = np.bincount(c.text, size[c.slot], len(texts)).astype(np.int64)
        return flat[spans(begin[c.slot], size[c.slot])], each


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", table_rows: int = TABLE_ROWS) -> DataFrame:
    """docs with an array column `out`: the ids of each row's whole text as the library gives them, and the end's id.

    path: the model. Null counts as empty: the end alone. Texts are of any
    length; repeated rows give the same; a literal marker in a text is a space's.
    Other columns stay, whatever their names (one called `out` is an error). An
    empty table gives an empty result. Two passes read docs, so its rows should
    come from files.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out!r} already")
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(checked(path))
    table = segmented(frequent(save(counted(docs, text_col), "chunk-counts"), table_rows), sent)
    shared = spark.sparkContext.broadcast(Table(table.toArrow()))  # at most table_rows of TABLE_BYTES

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sp, made = library(sent.value), []
            for _, part in chunks(batch.to_pylist()):
                ids, each = shared.value.encode(sp, part)
                ends = np.cumsum(each)
                offsets = np.concatenate(([0], np.cumsum(each + 1))).astype(np.int32)
                made.append(pa.ListArray.from_arrays(offsets, pa.array(np.insert(ids, ends, np.int32(sp.eos_id())))))
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))
            batch = made = None
            release()

    return docs.withColumn(out, run.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


class Decoder:
    """What the library decodes lists of ids to, by their distinct chunks."""

    def __init__(self, model: bytes):
        self.sp = library(model)
        n = self.sp.get_piece_size()
        self.marked = np.fromiter((self.sp.id_to_piece(i).startswith(MARK) for i in range(n)), bool, n)
        self.control = np.fromiter((self.sp.is_control(i) for i in range(n)), bool, n)
        self.before = next(i for i in range(n) if not (self.marked[i] or self.control[i] or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)))

    def decode(self, ids: np.ndarray, each: np.ndarray) -> pa.Array:
        """The texts of lists of ids, which stand end to end and of which each has so many."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.marked)):
            raise ValueError("an id isn't in the vocabulary")
        last = np.cumsum(each)
        real = np.concatenate(([0], np.cumsum(~self.control[ids])))
        owner = np.repeat(np.arange(len(each)), each)
        opens = self.marked[ids] & (real[:-1] > real[(last - each)[owner]])  # what precedes the first piece, if anything, belongs to it
        first = np.zeros(len(ids) + 1, bool)
        first[(last - each)[each > 0]] = True
        start = np.flatnonzero(opens | first[:-1])
        offsets = pa.py_buffer((4 * np.append(start, len(ids))).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(ids.astype("<i4").tobytes())]).dictionary_encode()
        found = [np.frombuffer(x, "<i4").tolist() for x in coded.dictionary.to_pylist()]
        skip = len(self.sp.decode([self.before]))
        middle = [x[skip:] for x in self.sp.decode([[self.before, *x] for x in found])] if found else []
        slot = coded.indices.to_numpy().astype(np.int64)
        begins = first[start]
        kinds, at = np.unique(slot[begins], return_inverse=True)
        slot[begins] = len(found) + at
        texts = middle + (self.sp.decode([found[k] for k in kinds.tolist()]) if len(kinds) else [])
        taken = pa.array(texts, pa.string()).take(pa.array(slot))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        upto = ends[np.searchsorted(start, last, "left")]
        return pa.Array.from_buffers(pa.string(), len(each), [None, pa.py_buffer(np.concatenate(([0], upto)).astype(np.int32)), data])


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a string column `out`: what the library decodes the whole list of ids in `ids_col` to.

    Null and empty lists, and null ids, give no text; ids that aren't in the
    vocabulary are an error. Any lists can be decoded, not only encoded ones:
    control pieces vanish, broken bytes become the library's signs for them.
    Other columns stay (one called `out` is an error); an empty table gives an
    empty result.
    """
    if out.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {out!r} already")
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(checked(path))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(sent.value)
        for batch in batches:
            made, k = [], 0
            size = batch.value_lengths().to_numpy().astype(np.int64)
            group = np.cumsum(size) // 500_000
            while k < len(batch):  # a run of lists of about so many ids
                to = int(np.searchsorted(group, group[k], "right"))
                made.append(decoder.decode(batch.slice(k, to - k).flatten().to_numpy(), size[k:to]))
                k = to
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())
            batch = made = None
            release()

    held = F.coalesce(F.filter(F.col(ids_col), lambda x: x.isNotNull()), F.array().cast("array<int>"))
    return rows.withColumn(out, run.asNondeterministic()(held))
