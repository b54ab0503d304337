"""Vectorised helpers that run inside Spark's Arrow tasks.

A batch of texts is looked at as one byte array with row offsets.  Words are
byte runs; a word's hash adds a scrambled value of each byte and its place, and
hashes of word windows join the hashes of two halves, scrambled at every step.
No hash is a polynomial: those modulo 2**64 are equal for some pairs of regular
words whatever their base.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PLACE_SALT, JOIN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Places of a word whose values are kept in a table; those behind are computed.
PLACES = 32
CHUNK_BYTES = 1 << 18
#: Bytes that a task sends to Spark at once, about.
PIECE_BYTES = 1 << 21

#: Bytes of words under the contract's class ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def trim() -> None:
    """Gives freed memory back, so that a reused Python worker does not keep a task's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in batches of about ``size`` bytes, one row at least."""
    rows = batch.num_rows if batch.nbytes <= size else max(1, batch.num_rows * size // batch.nbytes)
    yield from (batch.slice(lo, rows) for lo in range(0, max(1, batch.num_rows), max(1, rows)))


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, with ``trim`` at its end; what it yields goes in small pieces, which the JVM holds outside its heap."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield from pieces(batch)
        finally:
            trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _place_values(code: np.ndarray) -> np.ndarray:
    """The value of each ``place << 8 | byte``."""
    return mix(code.astype(U64) + U64(PLACE_SALT))


PLACE_VALUES = _place_values(np.arange(PLACES << 8))


def mix1(x: int) -> int:
    """``mix`` of one integer."""
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bufs, n = column.buffers(), len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes (one row at least): lo, hi, bytes, offsets."""
    data, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the range of its words."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, independent of where it stands."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    code = (at - np.repeat(first, size)) << 8 | data[at + np.repeat(starts - first, size)]
    value = PLACE_VALUES[np.minimum(code, len(PLACE_VALUES) - 1)]
    far = np.flatnonzero(code >= len(PLACE_VALUES))
    value[far] = _place_values(code[far])
    return mix(np.add.reduceat(value, first) + size.astype(U64))


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each ``k`` consecutive entries of ``h`` (across rows; callers mask)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    join = lambda a, b: mix(a * U64(JOIN) + b + U64(salt))
    size = 1
    while 2 * size <= k:
        h = join(h[:-size], h[size:])
        size *= 2
    if size < k:
        h = join(h[:n], h[k - size :])
    return mix(h + U64(k))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit values, Spark's ``bigint``."""
    return np.ascontiguousarray(x).view(np.int64)
