"""Words of texts as spans of bytes with 64-bit hashes, for operators whose words end at ASCII characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from folioframe.llm.common import mix64, parts

#: Bytes that are turned into arrays at once; bounds memory, not results.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64)] * 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte 0 if it is part of a word, 1 if it ends one, 2 if it ends a piece of words too."""
    kind = np.zeros(256, np.uint8)
    kind[list(spaces)], kind[list(breaks)] = 1, 2
    return kind


@dataclass
class ByteWords:
    """Words of some texts, A-Z in lower case: whose[i] is the text of word i, data[start[i]:end[i]] its bytes, and
    words with the same `piece` stand in one piece of one text."""
    data: np.ndarray
    whose: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    hash: np.ndarray

    def text(self, first: int, last: int) -> str:
        return b" ".join(self.data[self.start[i]:self.end[i]].tobytes() for i in range(first, last + 1)).decode()


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        _POWERS[:] = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n + n // 4, b)])) for b in (_BASE, _INVERSE))
    return _POWERS


def _words(texts: list[bytes], kind: np.ndarray) -> ByteWords:
    """All words of the texts, hashed a PIECE at a time; a piece ends where a word does."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    data = _LOWER[data]
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = kind[data]
    of[ends - 1] = 2  # no word or piece goes from one text into the next
    word = of == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(of == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    hashed, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + PIECE, "right")))
        some = data[low:end[to - 1]]
        power, inverse = _powers(len(some) + 1)
        run = np.zeros(len(some) + 1, np.uint64)
        np.cumsum((some + np.uint64(1)) * power[:len(some)], out=run[1:])
        a, b = start[at:to] - low, end[at:to] - low
        hashed[at:to] = mix64((run[b] - run[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = to
    return ByteWords(data, np.searchsorted(ends, start, "right"), start, end, piece, hashed)


def byte_words(texts: list, kind: np.ndarray) -> Iterator[tuple[int, int, ByteWords]]:
    """(first text, number of texts, their words), some texts at a time; None is empty."""
    raw = [(t or "").encode() for t in texts]
    for at, n in parts((len(t) for t in raw), rows=4096, total=PIECE):
        yield at, n, _words(raw[at:at + n], kind)
