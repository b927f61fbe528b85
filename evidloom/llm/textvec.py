"""Vectorised work on the UTF-8 bytes of an Arrow string column, for use inside Spark tasks.

A batch is cut into slabs of about ``SLAB`` bytes, and ``MOST`` documents at most, at document
ends, so that memory follows the slab and the longest single document, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None

SLAB = 1 << 19
MOST = 256
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV_BASE = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Returns freed memory to the system, which a worker would otherwise keep for as long as it lives."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run):
    """A function on the batches of a task that gives back what it freed once the task ends."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLAB + 1)
        for k, b in enumerate((_BASE, _INV_BASE)):
            x = np.full(n, b, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def byte_class(*ranges: tuple[int, int], but: bool = False) -> np.ndarray:
    """A table of 256 booleans; ``ranges`` are inclusive."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return ~t if but else t


#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), but=True)
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), but=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


@dataclass
class Slab:
    """Consecutive documents [first, last) of a batch: their bytes, and offsets into these."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def slabs(column, limit: int = SLAB, most: int = MOST) -> Iterator[Slab]:
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(i + most, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield Slab(i, j, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the slab
    ends: np.ndarray
    offsets: np.ndarray  # of each document's words: word k of document d is offsets[d] + k


def words(slab: Slab, word_byte: np.ndarray, lower: bool = True) -> tuple[Words, np.ndarray]:
    """Maximal runs of bytes of a class, none over a document's end, and the bytes they are in."""
    data = LOWER[slab.data] if lower else slab.data
    inside = word_byte[data]
    full = np.flatnonzero(np.diff(slab.offsets))
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[slab.offsets[full]] = False
        after[slab.offsets[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, slab.offsets)), data


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    power, inverse = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(_U))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of each document, and offsets of each document's.

    A document of fewer words, but not none, has one: its whole sequence.
    """
    count = np.diff(offsets)
    some = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(some, out=at[1:])
    code = mix(np.arange(1, size + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    out = np.zeros(at[-1], _U)
    if len(hashes) >= size:
        rolled = sum((hashes[k : len(hashes) - size + 1 + k] * code[k] for k in range(size)), np.zeros(len(hashes) - size + 1, _U))
        long = count >= size
        first = np.repeat(offsets[:-1][long], some[long])
        step = np.arange(len(first)) - np.repeat(np.cumsum(some[long]) - some[long], some[long])
        into = np.repeat(at[:-1][long], some[long])
        out[into + step] = rolled[first + step]
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = hashes[offsets[d] : offsets[d + 1]]
        out[at[d]] = (own * code[: len(own)]).sum(dtype=_U) ^ _U(len(own) << 56)
    return mix(out), at
