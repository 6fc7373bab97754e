"""Words of whole texts as arrays: the shared step of the operators that run inside Arrow batches.

A word is a maximal run of bytes other than blank and ``\\t \\n \\v \\f \\r``.
Everything works on the UTF-8 bytes of a column part, without a Python object
per word. Hashes have 64 bits; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: SQL pattern of a word, the same rule as below.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: Also parted by every ASCII character but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_LONG = 1 << 16  # a word beyond this many bytes is hashed on its own
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_LONG - 1, _BASE)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``data``: bytes (lower-cased if asked); word ``i`` is ``data[start[i]:end[i]]``; document ``d`` has the words
    ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + block, "right")))
            size = self.end[at:to] - self.start[at:to]
            if size.max() > _LONG:
                to = at + max(1, int(np.argmax(size > _LONG)))
                if self.end[at] - self.start[at] > _LONG:
                    piece = self.data[self.start[at]:self.end[at]].tobytes()
                    out[at] = int.from_bytes(blake2b(piece, digest_size=8).digest(), "little")
                    at += 1
                    continue
                size = self.end[at:to] - self.start[at:to]
            before = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(before, size)
            source = np.repeat(self.start[at:to], size) + within
            out[at:to] = np.add.reduceat(_BYTES[self.data[source]] * _POWERS[within], before)
            at = to
        return mix(out)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def split(texts: pa.Array, lower: bool = True, gaps: np.ndarray = _SPACE) -> Words:
    """The words of a string column; a null text counts as empty. ``gaps``: the bytes that part words."""
    data, bounds = utf8(texts)
    if lower:
        data = _LOWER[data]
    gap = gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    edge[-1] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def parts(batch: pa.RecordBatch, limit: int = 1 << 22, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text each: bounds what is held at a time."""
    if not batch.num_rows:
        return
    _, bounds = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay in one document, and the index of the first word of each.

    Runs double in length: a run of a + b words comes from one of a and one of b.
    """
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, length, block, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, length = block, size
            else:  # the part so far, then the block behind it
                m = len(h) - length - size + 1
                out = out[:m] * _POWERS[size] + block[length:length + m]
                length += size
        if size * 2 > n:
            break
        block = block[:len(block) - size] * _POWERS[size] + block[size:]
        size *= 2
    at = np.arange(total)
    room = np.repeat(first[1:], np.diff(first))[:total] - at  # words left in the document
    at = at[room >= n]
    return mix(out[at]), at
