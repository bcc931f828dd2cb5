"""Whole Arrow columns of text as numpy byte arrays, their words and word-window hashes.

A task reads its batches in slices of some megabytes (one document at least),
so memory follows the slice and the longest document, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_JOIN = np.uint64(0xD6E8FEB86659FD93)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _values(seed: int, lower: bool) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[_LOWER] if lower else table


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if n > SLICE_BYTES + (1 << 20):  # a single huge text; not kept
        return _running(_STEP, n), _running(_BACK, n)
    if n > len(_powers):
        _powers, _inverse = _running(_STEP, n), _running(_BACK, n)
    return _powers[:n], _inverse[:n]


def _running(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of a run of texts: byte spans, and for each text its first word and one past its last."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


@dataclass
class TextSlice:
    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, separator: np.ndarray = WHITE) -> Words:
        inside = ~separator[self.data]
        if not len(inside):
            none = np.zeros(0, np.int64)
            return Words(none, none, np.zeros(len(self.offsets), np.int64))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[at] = inside[at]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = at[at > 0] - 1
        ends[last] = inside[last]
        starts = np.flatnonzero(begins)
        return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets))

    def word_hashes(self, words: Words, seed: int = 1, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        n = len(self.data)
        if not len(words.starts):
            return np.zeros(0, np.uint64)
        powers, inverse = _grown(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_values(seed, lower)[self.data] * powers, out=total[1:])
        return mixed((total[words.ends] - total[words.starts]) * inverse[words.starts] + (words.ends - words.starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` hashes, by its first place; runs across texts are for the caller to skip."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= _JOIN
        out += hashes[j : j + n]
    return mixed(out + np.uint64(width))


def give_back() -> None:
    """Workers stay when their stage is over, and share the executor's memory: what is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Runs of rows of about ``limit`` bytes; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    rows = len(column)
    if not rows:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + rows + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : last + 1]
        yield TextSlice(first, last, whole[own[0] : own[-1]], own - own[0])
        first = last
    pa.default_memory_pool().release_unused()  # workers stay when their stage is over, and share the executor's memory
