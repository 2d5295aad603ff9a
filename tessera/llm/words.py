"""The words of a batch of texts as one Arrow array, cut at bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .encoder import spans


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


class Words:
    """The words of texts, end to end: `text` has each one's text, `begin` and `end` its bytes in `data`, `array` its value.

    A word is a longest run of bytes other than `gaps` and `breaks`. `piece`
    rises with each text and each break byte, so two words are in one piece of a
    text if it is equal. `lower` folds A-Z.
    """

    def __init__(self, texts: list[str], gaps: bytes, breaks: bytes = b"", lower: bool = False):
        raw = [t.encode() for t in texts]
        self.texts = len(raw)
        self.data = np.frombuffer(b"".join(x for t in raw for x in (t, gaps[:1])), np.uint8).copy()
        if lower:
            self.data[(self.data >= 65) & (self.data <= 90)] += 32
        stops = byte_set(breaks)[self.data] if breaks else None
        self.inside = ~(byte_set(gaps + breaks)[self.data])
        edge = np.flatnonzero(np.diff(self.inside, prepend=False))
        self.begin, self.end = edge[::2], edge[1::2]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.last = np.cumsum(size)
        self.text = np.searchsorted(self.last, self.begin, "right")
        self.piece = self.text if stops is None else self.text + np.cumsum(stops)[self.begin]

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def each(self) -> np.ndarray:
        """How many words each text has."""
        return np.bincount(self.text, minlength=self.texts).astype(np.int64)

    @property
    def array(self) -> pa.Array:
        size = np.concatenate(([0], np.cumsum(self.end - self.begin))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(size), pa.py_buffer(self.data[self.inside])])

    def numbers(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number among the distinct ones, and those."""
        coded = self.array.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The texts' words of which kept is true, joined by one space."""
        data, keep = self.data.copy(), self.inside.copy()
        keep[spans(self.begin[~kept], (self.end - self.begin)[~kept])] = False
        at = np.flatnonzero(kept)
        between = at[:-1][self.text[at[1:]] == self.text[at[:-1]]]
        keep[self.end[between]] = True
        data[self.end[between]] = 0x20
        size = np.concatenate(([0], np.cumsum(keep)[self.last - 1])).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), self.texts, [None, pa.py_buffer(size), pa.py_buffer(data[keep])])
