"""Instantaneous codes at many bit positions at once, on NumPy arrays.

A reader takes an array of bit positions and gives the values there and the positions behind
them. Codes of many vertices are read side by side; where few are left (the tail of a
hub), the codes at all positions of a slice are read and the chain through them is followed.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A slice of a bit stream, most significant bit first; it is padded with ones."""

    def __init__(self, raw: bytes):
        self.size = 8 * len(raw)
        self.words = np.frombuffer(bytes(raw) + b"\xff" * (-len(raw) % 8 + 16), ">u8").astype(np.uint64)
        self.last = (len(self.words) - 2) * 64

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from each position."""
        at = np.minimum(at, self.last)
        i, s = at >> 6, (at & 63).astype(np.uint64)
        return (self.words[i] << s) | (self.words[i + 1] >> _ONE >> (np.uint64(63) - s))

    def take(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """``width`` bits (64 at most) from each position, as a number."""
        return self.window(at) >> (64 - width).astype(np.uint64)

    def _zeros(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window at each position and the zeros before its first one."""
        w = window = self.window(at)
        n = np.zeros(len(at), np.int64)
        empty = np.flatnonzero(w == 0)
        while len(empty):
            n[empty] += 64
            more = self.window(at[empty] + n[empty])
            if w is window:
                w = window.copy()
            w[empty] = more
            empty = empty[more == 0]
        # no two neighbouring bits are left, so the conversion cannot round up to the next power
        n += 1086 - ((w & ~(w >> _ONE)).astype(np.float64).view(np.int64) >> 52)
        return window, n

    def unary(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self._zeros(at)[1]
        return n, at + n + 1

    def gamma(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, h = self._zeros(at)
        u = h.astype(np.uint64)
        value = (w << u) >> (np.uint64(63) - u)
        if (wide := np.flatnonzero(h > 31)).size:
            value[wide] = self.take(at[wide] + h[wide], h[wide] + 1)
        return value.astype(np.int64) - 1, at + 2 * h + 1

    def delta(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, at = self.gamma(at)
        width = np.minimum(width, 63)  # larger only where no code starts
        return (self.take(at, width) + (_ONE << width.astype(np.uint64))).astype(np.int64) - 1, at + width

    def zeta(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        w, h = self._zeros(at)
        rest = w << h.astype(np.uint64) << _ONE
        if (wide := np.flatnonzero(h * (k + 1) + k + 1 > 64)).size:
            rest[wide] = self.window(at[wide] + h[wide] + 1)
        width = np.minimum(h * k + k - 1, 63)
        left = _ONE << (h * k).astype(np.uint64)
        short = rest >> (64 - width).astype(np.uint64)
        long = short >= left
        value = np.where(long, rest >> (63 - width).astype(np.uint64), short + left)
        return value.astype(np.int64) - 1, at + h + 1 + width + long

    def reader(self, kind: str, k: int = 3):
        return (lambda at: self.zeta(at, k)) if kind == "ZETA" else getattr(self, kind.lower())

    def fixed(self, width: int):
        return lambda at: (self.take(at, np.full(len(at), width)).astype(np.int64), at + width)


def _follow(read, at: int, out: np.ndarray) -> int:
    """Fills ``out`` with successive codes from one position; the position behind them."""
    done = 0
    while done < len(out):
        span = min(max(16 * (len(out) - done), 64), 1 << 17)
        value, behind = read(np.arange(at, at + span))
        to, picks, p, want = memoryview(behind - at), [], 0, len(out) - done
        while p < span and len(picks) < want:
            picks.append(p)
            p = to[p]
        out[done : done + len(picks)] = value[picks]
        done, at = done + len(picks), at + p
    return at


def runs(read, at: np.ndarray, counts: np.ndarray, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """``counts[i]`` successive codes from ``at[i]``, one run behind the other, and the positions behind."""
    order = np.argsort(-counts, kind="stable")
    fewer, p = -counts[order], at[order]
    start = (np.cumsum(counts) - counts)[order]
    out, step = np.empty(int(counts.sum()), np.int64), 0
    while (n := int(np.searchsorted(fewer, -step))) >= few:
        out[start[:n] + step], p[:n] = read(p[:n])
        step += 1
    for i in range(n):
        p[i] = _follow(read, int(p[i]), out[start[i] + step : start[i] - fewer[i]])
    behind = np.empty_like(p)
    behind[order] = p
    return out, behind


def values_of_file(path: str, count: int, kind: str, k: int = 3, size: int = 1 << 16):
    """Arrays of the ``count`` codes a file starts with, in memory bounded by ``size`` bytes."""
    with open(path, "rb") as f:
        raw, at = f.read(size), 0
        while count:
            bits = Bits(raw)
            value, behind = bits.reader(kind, k)(np.arange(at, bits.size))
            to, picks, p = memoryview(behind), [], at
            while p < bits.size and len(picks) < count and to[p - at] <= bits.size:
                picks.append(p - at)
                p = to[p - at]
            if picks:
                yield value[picks]
                count -= len(picks)
            if count:
                more = f.read(size)
                if not more:
                    raise ValueError(f"{path} ends {count} codes early")
                raw, at = raw[p // 8 :] + more, p % 8


def _length(n: np.ndarray) -> np.ndarray:
    """Bits of positive numbers; no two neighbouring ones are left, so the conversion cannot round up."""
    return np.frexp((n & ~(n >> 1)).astype(np.float64))[1].astype(np.int64)


def gamma_codes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gamma codes of numbers, each as the number its bits make and their count."""
    return n + 1, 2 * _length(n + 1) - 1


def zeta_codes(n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with zeta codes."""
    n = n + 1
    h = (_length(n) - 1) // k
    left = np.left_shift(1, h * k)
    rest, width = n - left, h * k + k - 1
    long = rest >= left
    width = width + long
    return np.left_shift(1, width) | np.where(long, n, rest), h + 1 + width


def pack(value: np.ndarray, width: np.ndarray) -> tuple[bytes, int]:
    """Codes behind each other, padded with zeros, and their bits. A code may be wider than 64 bits if its number is not."""
    end = np.cumsum(width)
    size = int(end[-1]) if len(end) else 0
    words = np.zeros(-(-size // 64), np.uint64)
    if size:
        at, value = (end - 1) >> 6, value.astype(np.uint64)
        shift = (63 - ((end - 1) & 63)).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        words[at[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = value >> _ONE >> (np.uint64(63) - shift)
        split = np.flatnonzero(over)  # one code at most begins in a word and ends in the next
        words[at[split] - 1] |= over[split]
    return words.astype(">u8").tobytes()[: -(-size // 8)], size
