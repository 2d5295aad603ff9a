"""Collocations by suffix sorting: truncated suffixes shuffled once, all their prefixes counted with one stack.

Every word begins a suffix: itself and the words after it in its piece, up to
max_n. A worker combines the equal suffixes of a batch. They are then dealt by
ranges of (language, first word, rest) and sorted in reverse, so that longer
ones come before their prefixes; one pass over a range holds a stack of the
prefixes that are open, sums what belongs to each, and emits it when it closes.
A range may begin or end within a first word, so a hot one is spread over many
ranges: the prefixes open at either end of a range (max_n of each at most) are
partial, and their parts are summed afterwards. Others are whole, and dropped at
once if they are too rare, which is safe, as a phrase's parts occur as often as
it does.

Scores and the removal of phrases within longer ones are joins of that table
with itself. Only counts of frequent phrases get there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, release, save, ship
from .words import Words

#: The contract's separators: of words within a piece, and of pieces.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Characters that a worker handles at once.
BATCH = 3_000_000
#: Ends each word of a key, so that the suffixes with a prefix stand together in the order of their strings; no word has it.
STOP = "\t"
#: Parts of a language whose best are found before they meet.
PARTS = 64
COUNTED = "lang string, phrase string, words int, n long, partial boolean"


def combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of small numbers, and how often each occurs."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        return list(rows.T), n
    key = np.zeros(len(columns[0]), np.int64)
    for c, b in zip(columns, bits, strict=True):
        key = key << b | c
    key, n = np.unique(key, return_counts=True)
    out = []
    for b in reversed(bits):
        out.append(key & ((1 << b) - 1))
        key = key >> b
    return out[::-1], n


def suffixes(texts: list[str], langs: list[str], max_n: int) -> pa.RecordBatch:
    """(lang, key, n): the truncated suffixes that begin with each word of the texts; equal ones are one row."""
    words = Words(texts, GAPS, BREAKS, lower=True)
    coded = pa.array(langs, pa.string()).dictionary_encode()
    at, distinct = words.numbers()
    columns = [coded.indices.to_numpy()[words.text].astype(np.int64), at.astype(np.int64) + 1]
    for k in range(1, max_n):
        after = np.zeros(len(at), np.int64)
        same = np.flatnonzero(words.piece[k:] == words.piece[: len(at) - k]) if len(at) > k else np.empty(0, np.int64)
        after[same] = columns[1][same + k]
        columns.append(after)
    (lang, *found), n = combined(columns)
    ended = pc.binary_join_element_wise(distinct.cast(pa.string()), "", STOP)
    parts = [ended.take(pa.array(x - 1, mask=x == 0)) for x in found]
    key = pc.binary_join_element_wise(*parts, "", null_handling="skip")
    return pa.record_batch([coded.dictionary.take(pa.array(lang)), key, pa.array(n.astype(np.int64))], ["lang", "key", "n"])


class Stack:
    """Counts all prefixes of a range's keys, which come in reverse order; the prefix of no words is the language."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.last: list[str] = []  # language and words of the row before
        self.open: list[list | None] = [None] * (max_n + 1)  # of each length: language and words, count, whether it was open when the range began

    def push(self, lang: pa.Array, key: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        """What closes with these rows."""
        split = pc.split_pattern(key, STOP)
        size = split.value_lengths().to_numpy() - 1  # the last word is ended too
        begin = np.cumsum(size + 1) - size - 1
        words = split.flatten().dictionary_encode()
        number, depth = words.indices.to_numpy(), self.max_n + 1
        codes = np.full((depth, len(n)), -1, np.int64)
        codes[0] = lang.dictionary_encode().indices.to_numpy()
        for d in range(1, depth):
            has = size >= d
            codes[d, has] = number[begin[has] + d - 1]
        row = lambda i, d: [lang[i].as_py(), *(words.dictionary[number[begin[i] + k]].as_py() for k in range(d))]
        first, began = row(0, size[0]), not self.last
        fresh, out = np.zeros(len(n), bool), []
        for d in range(depth):
            fresh[1:] |= codes[d, 1:] != codes[d, :-1]
            fresh[0] |= self.last[d : d + 1] != first[d : d + 1] or d >= len(first)
            start = np.flatnonzero(fresh)
            if self.open[d]:
                self.open[d][1] += int(n[: start[0] if len(start) else len(n)].sum())
            if not len(start):
                continue
            sums = np.add.reduceat(n, start)
            if self.open[d]:
                out.append((d, *self.open[d]))
            sure = np.flatnonzero((codes[d, start] >= 0) & ((sums >= self.least) | (d == 0) | ((start == 0) & began)))
            groups = [[row(start[k], d), int(sums[k]), began and start[k] == 0] for k in sure[sure < len(start) - 1].tolist()]
            out += [(d, *g) for g in groups]
            k = start[-1]
            self.open[d] = [row(k, d), int(sums[-1]), bool(began and k == 0)] if codes[d, k] >= 0 else None
        self.last = row(len(n) - 1, size[-1])
        return self.rows(out)

    def end(self) -> pa.RecordBatch:
        """What is open when the range ends: partial."""
        return self.rows([(d, o[0], o[1], True) for d, o in enumerate(self.open) if o])

    def rows(self, found: list[tuple[int, list[str], int, bool]]) -> pa.RecordBatch:
        kept = [(w[0], " ".join(w[1:]), d, n, bool(partial)) for d, w, n, partial in found if n >= self.least or partial or d == 0]
        lang, phrase, words, n, partial = zip(*kept, strict=True) if kept else ((),) * 5
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(n, pa.int64()), pa.array(partial, pa.bool_())], ["lang", "phrase", "words", "n", "partial"])


def counted(docs: DataFrame, text_col: str, lang_col: str, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, words, n): all phrases of up to max_n words that occur at least so often; the phrase of no words has all of a language's words."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, part in chunks(batch.column(0).to_pylist(), BATCH):
                yield suffixes(part, langs[first : first + len(part)], max_n)
            batch = part = None
            release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least)
        for batch in batches:
            if batch.num_rows:
                yield stack.push(batch.column(0), batch.column(1), batch.column(2).to_numpy())
        yield stack.end()
        release()

    order = [F.col("lang").desc(), F.col("key").desc()]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    dealt = rows.mapInArrow(cut, "lang string, key string, n long").repartitionByRange(*order).sortWithinPartitions(*order)
    found = save(dealt.mapInArrow(count, COUNTED), "prefixes")
    parts = found.filter("partial or words = 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))
    return found.filter("not partial and words > 0").drop("partial").unionByName(parts)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = 3, least: int = 10, top: int | None = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_n words.

    Texts are lower-cased (A-Z), and words and pieces as GAPS and BREAKS cut
    them. a, l, r: how often the phrase, and its parts at the lowest-scoring cut
    (of equal ones the first), occur within pieces, overlaps included; n: all
    words of the language. A phrase is left out if one of up to max_n words that
    holds it occurs at least `share` hundredths as often. Order: score, a, both
    descending, phrase by its bytes. top: how many of each language (None: all).

    Null and empty texts have no words, a null language is `und`. Repeated rows
    count as often as they occur. Texts are whole, of any length. Extra columns
    are ignored; an empty table gives an empty result. Counts up to 10**15.
    """
    if max_n < 2 or least < 1:
        raise ValueError("phrases have two words at least, and occur once at least")
    table = save(counted(docs, text_col, lang_col, max_n, least), "phrases")
    some = table.filter("words > 0").select("lang", "phrase", "n")
    totals = table.filter("words = 0").select(F.col("lang").alias("of"), F.col("n"))
    found = table.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")

    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side in ("left", "right"):
        part = some.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias(side[0]))
        cuts = cuts.join(part, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    scored = cuts.select("lang", "phrase", "a", F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("s"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))

    inner = found.filter("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select(F.col("lang").alias("of"), join(F.col("at"), F.col("size")).alias("part"), F.col("a").alias("longer")).groupBy("of", "part").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inner, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))

    out = kept.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        out = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top).drop("part")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    out = out if top is None else out.filter(F.col("rank") <= top)
    return out.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
