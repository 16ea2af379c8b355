"""Whole columns of text as one array of bytes: slices, words and hashes without a loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd base, so that it has an inverse modulo 2^64.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


try:
    _libc = ctypes.CDLL("libc.so.6")
    # Arrays go back to the system when freed: M_MMAP_THRESHOLD (-3) fixed at 512 KB, one arena (M_ARENA_MAX, -8).
    _libc.mallopt(-3, 1 << 19)
    _libc.mallopt(-8, 1)
except (OSError, AttributeError):  # another C library
    _libc = None


def trim() -> None:
    """Gives memory of finished work back to the system; called between batches, as workers live on."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def powers(which: str, n: int) -> np.ndarray:
    """The first n powers of BASE ('up') or of its inverse ('down')."""
    if len(_powers[which]) < n:
        step = np.full(max(n, 1 << 16), BASE if which == "up" else BASE_INVERSE, np.uint64)
        step[0] = 1
        _powers[which] = np.cumprod(step, dtype=np.uint64)
    return _powers[which][:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; a row is never cut; null is empty."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end
    trim()


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit hashes that spreads every bit."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: spans of equal bytes have equal span_hash, wherever they stand."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed_bits((prefix[end] - prefix[start]) * powers("down", len(prefix))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and the row of each; runs never cross rows."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(firsts, lengths)
