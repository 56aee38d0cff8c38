"""Vectorised work on the UTF-8 bytes of many texts at once (numpy on Arrow string columns)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def byte_values(seed: int) -> np.ndarray:
    """256 fixed 64-bit values, one for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library
    _trim = None


def gave_back() -> None:
    """Returns a worker's freed memory to the system; Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; a longer row is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off_buf, data = column.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    gave_back()


def class_table(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


def word_spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word; words never cross rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    w = inside[buf]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    cuts = offs[:-1][offs[:-1] < len(buf)]
    before[cuts] = False
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: polynomial prefix sums, then a finalizer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
