"""Vectorised text kernels: words, hashes and sums over whole Arrow batches with numpy.

A block is a run of texts joined by newlines, a few MB long (one text at least, always whole). Word and
span hashes come from one prefix sum over the bytes of the block, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and bytes of non-ASCII characters; everything else separates words.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = True
WORDLIKE[128:] = True
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving what the task's allocators still hold back to the system at its end: workers outlive tasks."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of the multiplier and of its inverse; a worker keeps the largest table that it has needed."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _tables.append(np.multiply.accumulate(a))
    return _tables[0][:n], _tables[1][:n]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hashes' multiplier, and of its inverse, for at least ``size`` places."""
    return _powers(1 << int(max(1, size)).bit_length())


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


class Block:
    """Bytes of some texts with the words in them.

    ``starts``/``ends``: byte range of each word; ``first``: index of each text's first word, and the
    number of words last; ``text_start``: byte offset of each text, and the length last.
    """

    def __init__(self, texts: list[bytes], *, word_table: np.ndarray | None = None, lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = raw
        self.bytes = LOWER[raw] if lower else raw
        lens = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lens)))
        inside = ~WHITE[raw] if word_table is None else word_table[raw]
        inside[self.text_start[1:] - 1] = False
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, self.text_start)
        self._sums: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes in each range; equal bytes have equal hashes anywhere."""
        n = 1 << int(max(1, len(self.bytes))).bit_length()
        up, down = _powers(n)
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.bytes] * up[: len(self.bytes)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each text."""
        c = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        return c[self.text_start[1:] - 1] - c[self.text_start[:-1]]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; runs may cross texts, the caller masks those."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)
