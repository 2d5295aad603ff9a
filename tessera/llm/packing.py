"""Best-fit packing of tokenised documents with a swap-based local search.

1. One pass tokenises, cuts documents longer than a sequence, and writes one
   narrow row a piece (no tokens) with its rank among the task's pieces of the
   same length.
2. Only how many pieces have which length matters for packing: at most
   `capacity` numbers, whatever the corpus. On them, best fit in descending
   order of length makes bins as (pattern, multiplicity); a local search then
   exchanges pieces one for one, two for one, or moves them between underfull
   bins, each time increasing the sum of squared fills, until bins empty.
3. The plan says for each length which ranks go to which run of bins at which
   offset; pieces join it by length and rank. No text, token or unbounded group
   is ever shuffled or gathered.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, maybe_broadcast, release, save, ship
from .encoder import BATCH, Encoder
from .tokencount import Compiled, compiled, shared


def pieces(docs: DataFrame, tables: Compiled, capacity: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth) of docs (doc_id, text): nth is the rank among the task's pieces of that length."""

    ship(docs.sparkSession)
    sent = shared(docs.sparkSession, tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(sent.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs = batch["doc_id"]
            for at, texts in chunks(batch["text"], BATCH):
                ids, size = encoder.encode(texts, end)
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(len(texts)), parts)
                piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                # cut from the end: only the first piece may be shorter
                head = size - (parts - 1) * capacity
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                begin = (np.cumsum(size) - size)[doc] + start
                little = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(little[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                first = np.searchsorted(by, by, "left")
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - first + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pd.DataFrame({"doc_id": docs.iloc[at : at + len(texts)].to_numpy()[doc], "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "task": np.full(len(doc), task, np.int32), "nth": nth})
            texts = ids = little = doc = begin = None
            release()
        batch = docs = encoder = None
        release()

    return docs.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def best_fit(lengths: dict[int, int], capacity: int) -> Counter:
    """Bins as pattern (lengths in descending order) to multiplicity, by best fit in descending order."""
    done: Counter = Counter()
    left: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by room left
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        room = length
        while n:
            while room <= capacity and not left[room]:
                room += 1
            if room > capacity:  # new bins
                each = min(n, capacity // length)
                bins = n // each
                pattern = (length,) * each
                left[capacity - each * length][pattern] += bins
            else:
                pattern, many = next(iter(left[room].items()))
                each = min(n, room // length)
                bins = min(many, n // each)
                left[room][pattern] -= bins
                if not left[room][pattern]:
                    del left[room][pattern]
                left[room - each * length][pattern + (length,) * each] += bins
                pattern = ()
            n -= bins * each
            room = length
    for c in left:
        done.update(c)
    return done


def local_search(bins: Counter, capacity: int) -> Counter:
    """Fewer bins where moves and exchanges between underfull bins can empty some.

    The least filled bin gives to fuller ones: a piece moves where it fits,
    else a piece is exchanged for a shorter one, else for two that together are
    shorter, or two of its pieces for one. Each step makes a fuller bin fuller,
    so the sum of squared fills grows and the search ends by itself. An exchange
    is done in as many pairs of bins of the two patterns as there are, so the
    steps depend on the patterns and hardly on how many bins have them.
    """
    full = Counter({p: m for p, m in bins.items() if sum(p) == capacity})
    open_: Counter = Counter()
    # by how many pieces come back, their sum and the room, then the sum: patterns and the pieces
    index: list[dict[int, dict[int, dict]]] = [{}, {}, {}]
    volume = 0

    def parts(pattern: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, ...]]:
        """Up to two pieces by their number and sum."""
        out = {(0, 0): ()}
        for x, n in (held := Counter(pattern)).items():
            out[1, x] = (x,)
            for y in held:
                if y < x or (y == x and n > 1):
                    out.setdefault((2, x + y), (x, y))
        return out

    def put(pattern: tuple[int, ...], many: int) -> None:
        nonlocal volume
        if not pattern:
            return
        pattern, fill = tuple(sorted(pattern, reverse=True)), sum(pattern)
        if fill == capacity:
            full[pattern] += many
            return
        volume += fill * many
        if pattern not in open_:
            for (k, back), pieces in parts(pattern).items():
                index[k].setdefault(back + capacity - fill, {}).setdefault(back, {})[pattern] = pieces
        open_[pattern] += many

    def take(pattern: tuple[int, ...], many: int) -> None:
        nonlocal volume
        fill = sum(pattern)
        volume -= fill * many
        open_[pattern] -= many
        if open_[pattern]:
            return
        del open_[pattern]
        for k, back in parts(pattern):
            by = index[k][back + capacity - fill]
            del by[back][pattern]
            if not by[back]:
                del by[back]
            if not by:
                del index[k][back + capacity - fill]

    def swap(pattern: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
        rest = list(pattern)
        for x in out:
            rest.remove(x)
        return (*rest, *into)

    def step(low: tuple[int, ...]) -> bool:
        """One exchange from low to a bin at least as full, the one that leaves least room there, in all pairs of such bins."""
        best, mine = None, sum(low)
        for (given, total), give in parts(low).items():
            if not given:
                continue
            for k in (0, 1, 2) if given == 1 else (1,):
                for most in range(total, capacity if best is None else min(capacity, total + best[0] - 1) + 1):
                    found = next(
                        (
                            (most - total, other, give, back)
                            for sum_, of in index[k].get(most, {}).items()
                            if sum_ < total
                            for other, back in of.items()
                            if capacity - (most - sum_) >= mine and (other != low or open_[low] > 1)
                        ),
                        None,
                    )
                    if found:
                        best = found
                        break
        if best is None:
            return False
        _, other, give, back = best
        many = open_[low] // 2 if other == low else min(open_[low], open_[other])
        take(low, many)
        take(other, many)
        put(swap(low, give, back), many)
        put(swap(other, back, give), many)
        return True

    for pattern, many in bins.items():
        if sum(pattern) < capacity:
            put(pattern, many)
    better = True
    while better:  # passes over the patterns from the least filled, until one changes nothing
        better = False
        waiting = [(sum(p), p) for p in open_]
        heapq.heapify(waiting)
        while waiting and sum(open_.values()) > -(-volume // capacity):
            low = heapq.heappop(waiting)[1]
            while low in open_ and step(low):
                better = True
    return full + open_


def seats(bins: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): pieces of a length by rank to runs of bins."""
    out, rank, sequence = [], Counter(), 0
    for pattern, many in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            out.append((length, rank[length], rank[length] + many - 1, sequence, offset))
            rank[length] += many
            offset += length
        sequence += many
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each row of docs.

    A document is its ids, then `end`; null and empty texts are `end` alone.
    Documents longer than `capacity` are cut into full pieces, the first may be
    shorter. Texts are whole, of any length; pieces of one length are seated in
    the order of their tasks. Repeated rows and ids, null ids too, each are packed; extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = save(pieces(whole, compiled(path), capacity, end), "pieces")
    counts = save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = seats(local_search(best_fit(lengths, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(maybe_broadcast(base), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    seated = spark.createDataFrame(plan, "length long, low long, high long, first long, offset long")
    placed = ranked.join(maybe_broadcast(seated), (ranked.length == seated.length) & F.col("rank").between(F.col("low"), F.col("high")))
    return placed.select("doc_id", "piece", "start", ranked.length, "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
