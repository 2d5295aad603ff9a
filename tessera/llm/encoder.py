"""Token ids of whole texts, made once for each distinct segment of a batch."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .tokencount import Compiled, Counter

#: Characters that a worker encodes at once, and bytes from which a segment goes through the compiled tokenizer: long white space is too much for the other's patterns.
BATCH, LONG = 1_000_000, 10_000
#: Whether a byte after a space begins something other than white space for sure: not white space itself, and not the first byte of a character that might be.
SURE = np.ones(256, bool)
SURE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, end to end."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Segments:
    """The segments of a batch of texts, end to end: `text` has each one's text and `slot` its number among the distinct ones, whose `size` ids begin at `begin` in `flat`."""

    def __init__(self, text: np.ndarray, slot: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.text, self.slot, self.flat, self.begin, self.size = text, slot, flat, begin, size

    def ids(self) -> np.ndarray:
        return self.flat[spans(self.begin[self.slot], self.size[self.slot])]


class Encoder:
    """The ids that the tokenizer's library gives for whole texts; a special string within a text is one id.

    A space before a character that isn't white space always begins a
    pre-token, so the parts before and after it are tokenised apart. Arrow
    numbers the distinct segments of a batch, all are tokenised by rank in one
    call, and the ids are gathered. Long segments, and those with characters
    that the two libraries class differently (there is none with the versions at
    hand), go through the compiled tokenizer. Nothing is kept from batch to batch.
    """

    def __init__(self, compiled: Compiled):
        self.machine = Counter(compiled)
        self.special, self.last = compiled.special, compiled.last
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda text: [text]
        self.ranks = compiled.by_rank()
        self.apart = re.compile(f"[{re.escape(compiled.apart)}]").search if compiled.apart else lambda text: None
        self.width = np.zeros(1 + self.last, np.int64)
        for token, i in compiled.vocabulary.items():
            self.width[i] = len(token)

    def one(self, text: str) -> np.ndarray:
        """Ids of one segment."""
        if text in self.special:
            return np.array([self.special[text]], np.uint32)
        if len(text) >= LONG or self.apart(text):
            return self.machine.encode([text])[0].astype(np.uint32)
        return self.ranks.encode_to_numpy(text)

    def tokens(self, raw: bytes, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each segment begin and how many they are; the segments stand end to end."""
        data, first = np.frombuffer(raw + b"  ", np.uint8), np.concatenate(([0], end[:-1]))
        lead = (end - first > 1) & (end - first < LONG) & (data[first] == 0x20) & SURE[data[first + 1]]
        if self.apart(raw.decode()):
            lead &= np.fromiter((not self.apart(raw[a:b].decode()) for a, b in zip(first, end, strict=True)), bool, len(end))
        size, begin, ids, total = np.empty(len(end), np.int64), np.empty(len(end), np.int64), [], 0
        rest = np.ones(len(raw), bool)
        for i in np.flatnonzero(~lead).tolist():  # most begin a text, and nothing may stand before them
            ids.append(self.one(raw[first[i] : end[i]].decode()))
            size[i], begin[i] = len(ids[-1]), total
            total += len(ids[-1])
            rest[first[i] : end[i]] = False
        made = self.ranks.encode_to_numpy((raw if rest.all() else data[: len(raw)][rest].tobytes()).decode())
        last = np.searchsorted(np.cumsum(self.width[made]), np.cumsum((end - first)[lead]), "right")
        size[lead] = np.diff(last, prepend=0)
        begin[lead] = total + last - size[lead]
        return np.concatenate([*ids, made]), begin, size

    def segments(self, texts: list[str]) -> Segments:
        parts, owner = [], []
        for i, t in enumerate(texts):
            for part in self.cut(t) if any(s in t for s in self.special) else (t,):
                parts.append(part.encode())
                owner.append(i)
        width = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = b"".join(parts)
        if not raw:
            none = np.empty(0, np.int64)
            return Segments(none, none, none.astype(np.uint32), none, none)
        data = np.frombuffer(raw, np.uint8)
        opens = np.zeros(len(data), bool)
        opens[:-1] = (data[:-1] == 0x20) & SURE[data[1:]]
        first = np.cumsum(width) - width
        if len(parts) > len(texts):
            for k, part in enumerate(parts):
                if part.decode() in self.special:
                    opens[first[k] : first[k] + width[k]] = False
        opens[first[width > 0]] = True
        start = np.flatnonzero(opens)
        numbered = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        _, ends, distinct = numbered.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32)[1 : len(numbered.dictionary) + 1].astype(np.int64)
        text = np.array(owner, np.int64)[np.searchsorted(first + width, start, "right")]
        return Segments(text, numbered.indices.to_numpy(), *self.tokens(distinct.to_pybytes()[: ends[-1]], ends))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, `end` after each, and each text's number of ids."""
        s = self.segments(texts)
        each = np.bincount(s.text, s.size[s.slot], len(texts)).astype(np.int64)
        return np.insert(s.ids(), np.cumsum(each), np.uint32(end)), each + 1
