"""Words of many texts at once, straight from Arrow's UTF-8 buffers.

All separators the operators use are ASCII, so that words can be cut from the bytes without making Python strings.
A batch is handled in runs of whole rows of about ``RUN_BYTES``, which bounds memory whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 18

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
#: Lower-cases A-Z.
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 0x20
#: 1 for each byte that begins a code point.
LEAD = (IDENTITY & 0xC0) != 0x80

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _POW = np.multiply.accumulate(steps)
        steps[1:] = inverse
        _INV = np.multiply.accumulate(steps)
    return _POW[:n], _INV[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well-spread bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Consecutive texts: their bytes, and where each begins (one more offset than texts)."""

    data: np.ndarray
    offsets: np.ndarray
    separators: np.ndarray
    fold: np.ndarray

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.separators[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    @property
    def starts(self) -> np.ndarray:
        """First byte of each word."""
        return self._spans[0]

    @property
    def ends(self) -> np.ndarray:
        return self._spans[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Where each text's words begin among all words; one more than texts."""
        return np.searchsorted(self.starts, self.offsets, "left")

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def word_text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        """64 bits of each folded word: a polynomial over its bytes, mixed."""
        n = len(self.data)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.fold[self.data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix64((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``k`` words within one text."""
        h = self.hashes
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            total = (total ^ h[j : len(h) - k + 1 + j]) * np.uint64(0xD1342543DE82EF95) + np.uint64(2 * j + 1)
        first = np.flatnonzero(self.word_text[: len(h) - k + 1] == self.word_text[k - 1 :])
        return first, mix64(total[first])

    def count_bytes(self, of: np.ndarray) -> np.ndarray:
        """For each text, the number of bytes for which the table ``of`` is true."""
        return self.total(of[self.data])

    def total(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a run of its own."""
    offsets = _offsets(texts)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = max(row + 1, min(stop, len(texts)))
        yield row, stop
        row = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffer = texts.buffers()[1]
    if buffer is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buffer, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def cut(texts: pa.Array, start: int, stop: int, separators: np.ndarray = SPACE, fold: np.ndarray = IDENTITY) -> Texts:
    """Rows ``start`` to ``stop`` of a string array without nulls (see :func:`no_nulls`)."""
    offsets = _offsets(texts)[start : stop + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0], separators, fold)


def no_nulls(texts: pa.Array) -> pa.Array:
    """NULL texts count as empty ones."""
    return texts.fill_null("") if texts.null_count else texts
