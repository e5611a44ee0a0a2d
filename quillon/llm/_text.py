"""Words and hashes of many texts at once, on the UTF-8 bytes of Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as arrays of numbers at once.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def frugal(run: Callable) -> Callable:
    """run (batches -> batches) that gives free memory back when its rows are out: Python workers stay for the tasks of later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, mod 2 ** 64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (np.uint64(BASE), np.uint64(_BASE_INV))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high bits depend on all bits (the finaliser of splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and ends in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()) if column.type != pa.large_string() else column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is alone in its range."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of data; breaks are positions where a text starts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[breaks[breaks < len(data)]] = True
    edges = np.flatnonzero(edge)
    word = ~space[edges[:-1]]
    start, end = edges[:-1][word], edges[1:][word]
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def words(data: np.ndarray, at: np.ndarray, piece: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of consecutive texts, and where each text's words start.

    One text that is longer than `piece` is worked off in pieces that end between words, so memory beyond the hashes is bounded.
    """
    if len(at) > 2 or at[-1] - at[0] <= 2 * piece:
        h, start, _ = _piece(data[at[0] : at[-1]], at[:-1] - at[0])
        return h, np.searchsorted(start, at - at[0])
    found, a, end = [], int(at[0]), int(at[-1])
    while a < end:
        b = min(a + piece, end)
        while b < end:
            gap = np.flatnonzero(SPACE[data[b : b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + 4096, end)
        found.append(_piece(data[a:b], np.zeros(0, np.int64))[0])
        a = b
    h = np.concatenate(found)
    return h, np.array([0, len(h)])


_MULT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of one text; with fewer words, the whole sequence as one; none without words."""
    n = len(h)
    if not n:
        return h
    width = min(n, k)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out += h[i : n - width + 1 + i] * _MULT[i]
    return mix(out + np.uint64(width))
