"""Vectorised words, hashes and batches over Arrow text columns.

A batch is cut into chunks of about a quarter of a MB, so memory is bounded by the chunk size and the
longest single text. Words are maximal runs of non-separator bytes; hashes are polynomials
modulo 2**64 taken from prefix sums, so every word or shingle costs a few array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, SHIFT_A, SHIFT_B = U(0x9E3779B97F4A7C15 | 1), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

#: ASCII white space only, as in the pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer characters.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * SHIFT_A
    h ^= h >> U(27)
    h *= SHIFT_B
    h ^= h >> U(31)
    return h


#: Positions that a table of powers covers; longer arrays are hashed slice by slice.
SLICE = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``SLICE``: the same two small arrays whatever the texts."""
    if base not in _powers:
        up, down = np.full(SLICE, U(base)), np.full(SLICE, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[base]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Unmixed polynomial hash of values[start:end] for each span."""
    up, down = powers(base)
    total, n = np.zeros(len(values) + 1, U), len(values)
    if n < SLICE:
        np.cumsum(values * up[:n], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]
    step = pow(base, SLICE, 1 << 64)
    for k, at in enumerate(range(0, n, SLICE)):
        part = total[at + 1 : at + 1 + SLICE]
        np.multiply(values[at : at + SLICE], up[: len(part)], out=part)
        part *= U(pow(step, k, 1 << 64))
        np.cumsum(part, out=part)
        part += total[at]
    back, whole = pow(pow(base, -1, 1 << 64), SLICE, 1 << 64), np.empty(n // SLICE + 1, U)
    whole[0], whole[1:] = 1, U(back)
    np.multiply.accumulate(whole, out=whole)
    return (total[ends] - total[starts]) * (down[starts & (SLICE - 1)] * whole[starts >> (SLICE.bit_length() - 1)])


class Words:
    """Words of several texts: byte spans, and ``first[i]:first[i+1]`` as the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        if len(data):
            inside = ~separators[data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            lo = offsets[:-1][offsets[:-1] < len(data)]
            first[lo] = inside[lo]
            hi = offsets[1:][offsets[1:] > 0] - 1
            last[hi] = inside[hi]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        h = span_hash(self.data, self.starts, self.ends, 0x5851F42D4C957F2D)
        return mix(h + (self.ends - self.starts).astype(U) * BASE)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def window_hash(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Mixed hash of each run of ``size`` consecutive values, by start (len - size + 1 of them)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    if size <= 8:
        out = np.zeros(n, U)
        for i in range(size):
            out = out * U(base) + hashes[i : i + n]
        return mix(out)
    at = np.arange(n)
    return mix(span_hash(hashes, at, at + size, base))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of ``size`` words of one text starts."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bytes of text, about, that are worked on at a time; arrays over them stay within the CPU's caches.
CHUNK = 1 << 18
#: Texts of a chunk, at most.
ROWS = 4096
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps what it likes
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task then holds next to none."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunked(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text and at most ``ROWS`` rows each, with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1), at + ROWS)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    give_back()


def per_chunk(f: Callable, text: str = "text", limit: int = CHUNK) -> Callable:
    """For mapInArrow: f(batch, data, offsets) gives a RecordBatch for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunked(batches, text, limit):
            yield f(batch, data, offsets)

    return run


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i; zero for empty spans."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def minima(values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """Minimum of each span, ``empty`` for empty spans."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.minimum.reduceat(values, first[full])
    return out
