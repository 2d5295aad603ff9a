"""Token counts by a compiled finite-state tokenizer.

The tokenizer of a byte-level BPE file is compiled into two deterministic
transducers:

* An outer one over character classes (one symbol of look-ahead folded into the
  alphabet) whose eight states say where the pre-tokens begin. A transition that
  begins a pre-token is annotated with the number of tokens which that emits:
  after such a transition the state depends on the symbol alone, so the
  pre-token's end and the annotation don't depend on the state before it.
  A chunk of text thus is a map from entry state to exit state and emitted
  count. The maps of all chunks of a batch are made side by side, for the entry
  states that the symbols before a chunk leave possible, and are composed by a
  parallel prefix scan; a text's count is the difference of two prefixes.
* An inner one whose arcs are whole pre-tokens, each annotated with the number
  of tokens it emits. Arcs are compiled as they are first met, many at once,
  from the merge table, and forgotten when there are too many.

A document's count is the sum of the annotations along its path. Special
strings are cut out first and emit one token, as the library does.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, ship

#: Input symbols: letter, number, other, white space before white space or the end, last space of a run, other last
#: white space of a run, apostrophe that begins a contraction of two or of three characters, end of a text.
LETTER, NUMBER, OTHER, BLANK, SPACE, LAST, SHORT, LONG, STOP = range(9)
#: States: a token has ended, within letters, numbers, others, after a space that joins what follows, within white
#: space, one and two characters before a contraction's end.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANK, ONE_LEFT, TWO_LEFT = range(8)
#: Contractions of the splitting rule (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: The splitting rule (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, symbols before it that tell its entry states, and arcs that a worker remembers.
CHUNK, BEFORE, ARCS = 64, 4, 300_000
#: Bytes beyond which a pre-token is merged with a heap instead of in the batch.
LONG_BYTES = 96


def table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether the symbol begins a token, by state * 9 + symbol."""
    nxt, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    nxt[:] = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANK, AFTER_SPACE, FRESH, ONE_LEFT, TWO_LEFT, FRESH]
    for symbol, within in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        begins[within, symbol] = begins[AFTER_SPACE, symbol] = False
    for symbol in (SHORT, LONG):  # no contraction after a space or other signs
        for state in (IN_OTHERS, AFTER_SPACE):
            nxt[state, symbol], begins[state, symbol] = IN_OTHERS, False
    begins[IN_BLANK, BLANK] = False
    nxt[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = FRESH, False
    nxt[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, False
    return nxt.ravel(), begins.ravel()


def character_classes(tokenizer) -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE (the space) or LAST (other white space) of each code point, as the library has them.

    Code points that are newer than the tables at hand are put to the library.
    """
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = []
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (LAST, r"\s")):
        for m in regex.finditer(pattern, every):
            c = ord(m.group())
            out[c] = symbol
            if unicodedata.category(chr(c)) == "Cn":
                new.append(c)
    for a in range(0, len(new), 4000):
        part = new[a : a + 4000]
        text = "".join(f"a{chr(c)}\n1{chr(c)}\n!{chr(c)}\n" for c in part)
        begin = {o[0] for _, o in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        for i, c in enumerate(part):
            out[c] = LETTER if 9 * i + 1 not in begin else NUMBER if 9 * i + 4 not in begin else OTHER if 9 * i + 7 not in begin else LAST
    out[ord(" ")] = SPACE
    return out


def rank_classes() -> np.ndarray:
    """character_classes() as the library that takes ranks has them."""
    from tiktoken import Encoding

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for symbol, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (LAST, r"\s+")):
        alone = Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(alone.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = symbol
    out[0xD800:0xE000] = OTHER
    out[ord(" ")] = SPACE
    return out


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Compiled:
    """The dense tables of one tokenizer file; sent to the workers once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer or a prefix space can be compiled")
        vocab = spec["model"]["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        pair = left << 32 | right
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.special = {t["content"]: t["id"] for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain special strings can be compiled")
        self.classes = character_classes(Tokenizer.from_file(path))
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.vocabulary = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        #: The largest id.
        self.last = max([*vocab.values(), *self.special.values()])
        self.apart = "".join(map(chr, np.flatnonzero(self.classes != rank_classes()).tolist()))

    def by_rank(self):
        """The same splitting rule and merges for a library that takes the vocabulary as ranks."""
        from tiktoken import Encoding

        return Encoding("own", pat_str=SPLIT, mergeable_ranks=self.vocabulary, special_tokens={})


_compiled: dict[str, Compiled] = {}
_sent: dict[tuple[str, int], Broadcast] = {}


def compiled(path: str) -> Compiled:
    """The tables of a file, made once on the driver."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def shared(spark, tables: Compiled) -> Broadcast:
    """The tables as sent to the workers, once for each application: a few MB."""
    key = spark.sparkContext.applicationId, id(tables)
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(tables)
    return _sent[key]


class Counter:
    """A worker's machine: the compiled tables and the arcs met so far."""

    def __init__(self, compiled: Compiled):
        self.c = compiled
        self.next, self.begins = table()
        self.arcs: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, compiled.special))) if compiled.special else None
        self.by_pair = None

    def symbols(self, joined: str, ends: np.ndarray) -> np.ndarray:
        """The symbol of each character; ends: places of the characters that stand between texts."""
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.c.classes[code]
        kind[ends] = BLANK  # as white space to what is before
        white = kind >= BLANK
        follows = np.empty(len(kind), bool)
        follows[:-1], follows[-1] = white[1:], True
        out = kind
        out[white & follows] = BLANK
        for i in np.flatnonzero(code == ord("'")).tolist():
            after = joined[i : i + 3]
            if after[:2] in CONTRACTIONS:
                out[i] = SHORT
            elif after in CONTRACTIONS:
                out[i] = LONG
        out[ends] = STOP
        return out

    def grid(self, symbol: np.ndarray) -> np.ndarray:
        """The chunks as columns; what is missing of the last one stops."""
        rows = -(-len(symbol) // CHUNK)
        grid = np.full(rows * CHUNK, STOP, np.uint8)
        grid[: len(symbol)] = symbol
        return np.ascontiguousarray(grid.reshape(rows, CHUNK).T)

    def maps(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state by entry state and chunk; and for each character the entry states, as bits, from which a pre-token begins there: of those that are possible only."""
        rows = grid.shape[1]
        state = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
        image = state[:, 1:].copy()
        for j in range(CHUNK - BEFORE, CHUNK):
            image = self.next[image * np.uint8(9) + grid[j, :-1]]
        possible = np.zeros((8, rows), np.uint8)
        possible[FRESH, 0] = 1
        np.put_along_axis(possible[:, 1:], image.astype(np.intp), np.uint8(1), axis=0)
        possible <<= np.arange(8, dtype=np.uint8)[:, None]
        bits = np.empty(grid.shape, np.uint8)
        for j in range(CHUNK):
            at = state * np.uint8(9) + grid[j]
            bits[j] = np.bitwise_or.reduce(np.where(self.begins[at], possible, 0), axis=0)
            state = self.next[at]
        return state, bits

    @staticmethod
    def scan(maps: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """For each chunk the composition of the maps of all chunks up to it, with the counts emitted on the way."""
        maps, step = maps.copy(), 1
        counts = None if counts is None else counts.copy()
        while step < maps.shape[1]:
            through = maps[:, :-step].astype(np.intp)
            if counts is not None:
                counts[:, step:] = counts[:, :-step] + np.take_along_axis(counts[:, step:], through, axis=0)
            maps[:, step:] = np.take_along_axis(maps[:, step:], through, axis=0)
            step *= 2
        return maps, counts

    @staticmethod
    def entries(composed: np.ndarray) -> np.ndarray:
        """Entry state of each chunk."""
        return np.concatenate(([FRESH], composed[FRESH, :-1])).astype(np.uint8)

    def boundaries(self, symbol: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each character."""
        maps, bits = self.maps(self.grid(symbol))
        return (bits >> self.entries(self.scan(maps)[0]) & 1).astype(bool).T.ravel()[: len(symbol)]

    def ends(self, symbol: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the pre-tokens end that begin at these places."""
        end, state = start + 1, self.next[symbol[start]]  # as from FRESH: any state before gives the same
        going = np.arange(len(start))
        while len(going := going[end[going] < len(symbol)]):
            at = state[going] * np.uint8(9) + symbol[end[going]]
            on = ~self.begins[at]
            going, at = going[on], at[on]
            state[going] = self.next[at]
            end[going] += 1
        return end

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        parts, owner = texts, None
        if self.special and any(self.special.search(t) for t in texts):
            parts, owner = [], []
            for i, t in enumerate(texts):
                cut = self.special.split(t)
                extra[i] = len(cut) - 1
                parts += cut
                owner += [i] * len(cut)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        stops = np.cumsum(size + 1) - 1
        joined = "\n".join(parts) + "\n"
        symbol = self.symbols(joined, stops)
        maps, bits = self.maps(self.grid(symbol))
        entry = self.entries(self.scan(maps)[0])
        taken = bits >> entry & 1
        place = lambda at: np.flatnonzero(at.T.ravel()[: len(symbol)])
        start, other = place(taken), place(bits & ~(np.uint8(1) << entry))
        other = np.setdiff1d(other, start, assume_unique=True)
        begin = np.concatenate((start, other))
        end = np.concatenate((start[1:], [len(symbol)], self.ends(symbol, other)))
        emits = np.zeros(maps.shape[1] * CHUNK, np.int64)
        emits[begin] = self.annotate([joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        emits[stops] = 0
        emits = emits.reshape(-1, CHUNK).T
        along = np.stack([np.where(bits >> np.uint8(q) & 1, emits, 0).sum(axis=0) if (bits >> np.uint8(q) & 1).any() else np.zeros(maps.shape[1], np.int64) for q in range(8)])
        before = np.concatenate(([0], self.scan(maps, along)[1][FRESH, :-1]))
        within = np.cumsum(np.where(taken, emits, 0), axis=0)
        each = np.diff(before[stops // CHUNK] + within[stops % CHUNK, stops // CHUNK], prepend=0)
        if owner is not None:
            each = np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
        return each + extra

    def annotate(self, tokens: list[str]) -> np.ndarray:
        """What the arc of each pre-token emits; arcs that are new are compiled."""
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        out = np.fromiter(map(self.arcs.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            fresh = list({tokens[i] for i in missing})
            self.arcs.update(zip(fresh, self.compile([t.encode("utf-8") for t in fresh]).tolist(), strict=True))
            out[missing] = [self.arcs[tokens[i]] for i in missing]
        return out

    def compile(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word by the merge table."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        _, word = self.merge(np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), size))
        return np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (without special strings) end to end, and each text's number of ids; no arc is remembered."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1) - 1
        joined = "\n".join(texts) + "\n"
        begins = self.boundaries(self.symbols(joined, ends))
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        width[ends] = 0
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        whole = np.where(width == 0, 1, width)
        raw = raw[np.repeat(width > 0, whole)]
        ids, word = self.merge(raw, np.repeat(np.cumsum(begins), width))
        owner = np.repeat(np.arange(len(texts)), size + 1)[np.flatnonzero(begins)][word - 1] if len(word) else word
        return ids, np.bincount(owner, minlength=len(texts))

    def merge(self, raw: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and their words, in order, of bytes and their (ascending) words: a round applies every word's best merge."""
        ids = self.c.byte_ids[raw]
        none = np.int64(len(self.c.pairs))
        out_ids, out_word = [], []
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(ids) else np.empty(0, np.int64)
        length = np.diff(np.append(first, len(ids)))
        for i in np.flatnonzero(length > LONG_BYTES).tolist():
            made = self.merge_long(ids[first[i] : first[i] + length[i]].tolist())
            out_ids.append(np.array(made, np.int64))
            out_word.append(np.full(len(made), word[first[i]]))
        keep = np.repeat(length <= LONG_BYTES, length)
        ids, word = ids[keep], word[keep]
        while len(ids):
            pair = np.empty(len(ids), np.int64)
            pair[:-1], pair[-1] = ids[:-1] << 32 | ids[1:], -1
            pair[:-1][word[1:] != word[:-1]] = -1
            at = np.minimum(np.searchsorted(self.c.pairs, pair), none - 1)
            rank = np.where(self.c.pairs[at] == pair, self.c.ranks[at], none)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(ids)))
            done = np.repeat(best == none, length)
            out_ids.append(ids[done])
            out_word.append(word[done])
            hit = np.flatnonzero((rank == np.repeat(best, length)) & (rank < none))
            if len(hit):
                hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]  # each word's leftmost
            ids[hit] = self.c.merged[at[hit]]
            keep = ~done
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        if not out_ids:
            return ids, word
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The tokens of one long word, with a heap."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.c.pairs.tolist(), zip(self.c.ranks.tolist(), self.c.merged.tolist(), strict=True), strict=True))
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (found := self.by_pair.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i] << 32 | ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = self.by_pair[pair][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


def token_count(spark, path: str):
    """A column function: text to (n_bytes, n_tokens). The file is read on the driver; workers get the compiled tables."""
    ship(spark)
    sent = shared(spark, compiled(path))

    @F.pandas_udf(T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = Counter(sent.value)
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            size = [0] * 0
            for _, texts in chunks(batch):
                out.append(machine.counts(texts))
                size += [len(t.encode("utf-8")) for t in texts]
            yield pd.DataFrame({"n_bytes": np.array(size, np.int64), "n_tokens": np.concatenate(out)})

    return count.asNondeterministic()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    Counts are the library's without begin, end or added special tokens; a
    special string within a text is one token. Null counts as empty: no bytes,
    no tokens. Repeated rows and ids each give their row; extra columns are
    ignored; an empty table gives an empty result. Texts are whole, of any length.
    """
    count = token_count(docs.sparkSession, path)
    counted = docs.select(F.col(id_col).alias("doc_id"), count(text(text_col)).alias("t"))
    return counted.select("doc_id", F.col("t.n_bytes").alias("n_bytes"), F.col("t.n_tokens").alias("n_tokens"), (F.col("t.n_tokens") > limit).alias("over_limit"))


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
