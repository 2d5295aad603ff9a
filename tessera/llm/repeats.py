"""Periodic runs of words: aligned blocks searched across the text, and exact extension of what recurs at a fitting distance.

A run is a longest stretch of words with smallest period q (words q apart are
equal) that is at least `least` words and `times` periods long.

Each scale has blocks of b words, b a power of two, at multiples of b, and the
periods from b to 2b - 1 (the smallest scale also has those below b). A run is
so long that one of its blocks stands whole in it again a period later. So an
automaton with a scale's blocks as keys reads the text, and a block that recurs
at a distance of its scale is a seed: the stretch of equal words at that distance
around it is extended to both sides, word by word. A block with a word that
doesn't recur within the scale's reach can't seed, and isn't searched; most of
ordinary text goes here. A seed within a run of smaller period is of that run.

Texts are independent and nothing is shuffled. A worker holds about a million
characters or one text, and keys of at most 256 blocks or one scale's longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, free, release, ship
from .words import Words

#: White space of the contract; words are of any other characters.
GAPS = b" \t\n\x0b\x0c\r"
#: Blocks in an automaton at most.
BLOCKS = 256
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def smallest_block(least: int) -> int:
    """The largest power of two b so that a run of `least` words has a whole block of b, and its copy, at any period below 2b."""
    return 1 << max(0, ((least + 2) // 3).bit_length() - 1)


def next_place(ids: np.ndarray) -> np.ndarray:
    """How far each number's next occurrence is; beyond the end if there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids) + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def scales(n: int, least: int, times: int) -> Iterator[int]:
    """Block lengths whose periods a run in n words can have."""
    size = smallest_block(least)
    while n >= least and (size == smallest_block(least) or times * size <= n):
        yield size
        size *= 2


def may_seed(far: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of the blocks of `size` all whose words recur in reach. far: next_place() of all texts' words, of which text i has count[i] from first[i]."""
    blocks = np.maximum(count - 1, 0) // size  # one that ends the text has no copy after it
    text = np.repeat(np.arange(len(count)), blocks)
    place = size * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    bad = np.concatenate(([0], np.cumsum(far >= 2 * size)))
    at = first[text] + place
    good = bad[at] == bad[at + size]
    return text[good], place[good]


def seeds(ids: np.ndarray, places: np.ndarray, size: int, smallest: bool) -> np.ndarray:
    """(period, place) rows: blocks that stand again at a distance of their scale."""
    found = []
    for k in range(0, len(places), BLOCKS):
        part = places[k : k + BLOCKS]
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        kind: dict[int, int] = {}
        for p in part.tolist():
            key = tuple(ids[p : p + size].tolist())
            kind[p] = machine.get(key, p)  # the first place of the same words
            machine.add_word(key, kind[p])
        machine.make_automaton()
        cut = np.flatnonzero(np.diff(part, prepend=-4 * size) > 2 * size)
        for a, b in zip(part[cut].tolist(), part[np.append(cut[1:], len(part)) - 1].tolist(), strict=True):
            text = tuple(ids[a + 1 : b + 3 * size - 1].tolist())
            for end, value in machine.iter(text):
                at = a + 2 + end - size
                block = (at - 1) // size * size if smallest else (at // size - 1) * size
                for p in (block, block - size) if smallest else (block,):
                    if 0 < at - p < 2 * size and kind.get(p) == value:
                        found.append((at - p, p))
    return np.array(sorted(set(found)), np.int64).reshape(-1, 2)


def equal_up_to(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """The first place from `at` on, in steps of 1 or -1, whose word isn't that a period later; one outside the text if there is none."""
    width = 64
    while True:
        room = len(ids) - period - at if step > 0 else at + 1
        width = min(width, room)
        if width <= 0:
            return at
        a = at if step > 0 else at - width + 1
        differs = np.flatnonzero(ids[a : a + width] != ids[a + period : a + period + width])
        if len(differs):
            return a + int(differs[0] if step > 0 else differs[-1])
        at += step * width
        width = min(2 * width, 1 << 16)


class Known:
    """Runs found so far."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.runs, self.spans = ids, [], set()
        self.cover = np.zeros(len(ids) + 1, np.int64)  # of each place: the last end, and the number, of the runs that begin there or before
        self.shown = 0

    def add(self, begin: int, length: int, period: int) -> None:
        if (begin, length) not in self.spans:  # else it has a smaller period
            self.spans.add((begin, length))
            self.runs.append((begin, length, period))

    def show(self) -> None:
        """Lets cover know the runs added since."""
        for k in range(self.shown, len(self.runs)):
            begin, length, _ = self.runs[k]
            self.cover[begin] = max(self.cover[begin], (begin + length) << 32 | k)
        if self.shown < len(self.runs):
            self.cover = np.maximum.accumulate(self.cover)
        self.shown = len(self.runs)

    def end(self, at: np.ndarray) -> np.ndarray:
        return self.cover[at] >> 32

    def around(self, at: int, size: int) -> tuple[int, int, int] | None:
        """A run that holds the block there."""
        return self.runs[int(self.cover[at]) & 0xFFFFFFFF] if self.end(at) >= at + size else None

    def stretch(self, place: int, size: int, period: int) -> tuple[int, int]:
        """Where the stretch of words equal to those a period later, around a block that is, begins and ends.

        If the block and its copy are in two runs of one period below the
        block's size, the stretch ends where the first of them does, unless both end together.
        """
        left, right = place - 1, place + size
        one, two = self.around(place, size), self.around(place + period, size)
        if one and two and one[2] == two[2] <= size:
            begins, ends = (one[0], two[0] - period), (one[0] + one[1], two[0] + two[1] - period)
            left, right = max(begins) - 1, min(ends)
            return max(begins) if begins[0] != begins[1] else equal_up_to(self.ids, left, period, -1) + 1, right if ends[0] != ends[1] else equal_up_to(self.ids, right, period, 1)
        return equal_up_to(self.ids, left, period, -1) + 1, equal_up_to(self.ids, right, period, 1)


def find_runs(ids: np.ndarray, least: int = 24, times: int = 3, far: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbers, by start, then period."""
    known, far = Known(ids), next_place(ids) if far is None else far
    for size in scales(len(ids), least, times):
        _, places = may_seed(far, np.array([0]), np.array([len(ids)]), size)
        places = places[known.end(places) < np.minimum(places + 3 * size, len(ids))]
        rows = seeds(ids, places, size, size == smallest_block(least))
        groups = np.flatnonzero(np.diff(rows[:, 0], prepend=0))
        for own in np.split(rows, groups[1:]) if len(rows) else ():
            period, at, done = int(own[0, 0]), own[:, 1], -1
            for place in at[known.end(at) < at + period + size].tolist():
                if place >= done:
                    begin, done = known.stretch(place, size, period)
                    if done - begin + period >= max(least, times * period):
                        known.add(begin, done - begin + period, period)
            if period <= size:
                known.show()
        known.show()
    return sorted(known.runs)


def runs_of(texts: list[str], least: int, times: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], pa.Array]:
    """Number of words, runs, and collapsed text of each text."""
    words = Words(texts, GAPS)
    count = words.each
    first = np.cumsum(count) - count
    ids, _ = words.numbers() if len(words) else (np.empty(0, np.int32), None)
    far = next_place(ids)
    far[far > first[words.text] + count[words.text] - 1 - np.arange(len(ids))] = len(ids) + 1  # the next one is in another text
    hopeful = np.zeros(len(texts), bool)
    for size in scales(int(count.max(initial=0)), least, times):
        hopeful[may_seed(far, first, count, size)[0]] = True
    runs, dropped = [[] for _ in texts], np.zeros(len(ids) + 1, np.int64)
    for i in np.flatnonzero(hopeful & (count >= least)).tolist():
        own = slice(first[i], first[i] + count[i])
        runs[i] = find_runs(ids[own], least, times, far[own])
        for start, length, period in runs[i]:
            dropped[first[i] + start + period] += 1
            dropped[first[i] + start + length] -= 1
    return count, runs, words.joined(np.cumsum(dropped)[:-1] == 0)


def structs(count: np.ndarray, runs: list[list[tuple[int, int, int]]], collapsed: pa.Array) -> pa.StructArray:
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    ends = np.concatenate(([0], np.cumsum([len(own) for own in runs]))).astype(np.int32)
    names = ["start", "length", "period"]
    listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names))
    return pa.StructArray.from_arrays([pa.array(count), listed, collapsed], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", out: str = "found", least: int = 24, times: int = 3) -> DataFrame:
    """docs with a struct column `out` (n_words, runs, collapsed) of each row's whole text.

    Words are what white space (ASCII) parts. runs: (start, length, period) of
    every run, words numbered from 0, by start, then period; runs may overlap,
    and two may not have one start and length. collapsed: the words, joined by
    one space, without those that stand in a run after its first period. Null
    and empty texts, and those of white space only, have no words and no runs.
    Rows are independent: repeated ones give the same. Texts may be of any
    length. Other columns stay, whatever their names (one called `out` is an
    error); an empty table gives an empty result.
    """
    if times < 3 or least < 1:
        raise ValueError("runs have three periods at least")
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out!r} already")
    ship(docs.sparkSession)

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [structs(*runs_of(part, least, times)) for _, part in chunks(batch.to_pylist())]
            yield pa.concat_arrays(made) if made else structs(np.empty(0, np.int64), [], pa.array([], pa.string()))
            batch = made = None
            release()

    return docs.withColumn(out, run.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of docs for the registered query: where a tenth of the ids' checksums say so, the words from a place on repeat the next few."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    w, edit = free(docs, "_w", "_edit")
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.when(F.coalesce(h % 10 == 0, F.lit(False)), words).alias(w), F.floor(h / 10).cast("long").alias(edit))
    n, g = F.size(w), F.col(edit)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again: Column = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(w, 1, a), again), 1, n), " ")
    return rows.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))
