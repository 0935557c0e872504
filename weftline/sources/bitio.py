"""Instantaneous codes on strings of '0' and '1', most significant bit first.

``str.find`` and ``int(..., 2)`` run in C, which makes this the fastest plain-Python form for
the short codes of compressed graphs. Readers return (value, next position).
"""

from __future__ import annotations


def bits_of(raw: bytes) -> str:
    return bin(int.from_bytes(b"\x01" + raw, "big"))[3:] if raw else ""


def bytes_of(bits: str) -> bytes:
    pad = -len(bits) % 8
    return int(bits + "0" * pad or "0", 2).to_bytes((len(bits) + pad) // 8, "big") if bits else b""


def write_unary(n: int) -> str:
    return "0" * n + "1"


def write_gamma(n: int) -> str:
    low = bin(n + 1)[3:]
    return "0" * len(low) + "1" + low


def write_delta(n: int) -> str:
    low = bin(n + 1)[3:]
    return write_gamma(len(low)) + low


def write_zeta(n: int, k: int) -> str:
    n += 1
    h = (n.bit_length() - 1) // k
    left = 1 << (h * k)
    rest, width = n - left, h * k + k
    # minimal binary code of rest in an interval of (2**k - 1) * left values
    short = (1 << width) - ((left << k) - left)
    body = format(rest, f"0{width - 1}b") if rest < short and width > 1 else ("" if width == 1 else format(rest + short, f"0{width}b"))
    return "0" * h + "1" + body


def read_unary(s: str, at: int) -> tuple[int, int]:
    e = s.index("1", at)
    return e - at, e + 1


def read_gamma(s: str, at: int) -> tuple[int, int]:
    e = s.index("1", at)
    to = 2 * e - at + 1
    return int(s[e:to], 2) - 1, to


def read_delta(s: str, at: int) -> tuple[int, int]:
    width, at = read_gamma(s, at)
    return int("1" + s[at : at + width], 2) - 1, at + width


def read_zeta(s: str, at: int, k: int) -> tuple[int, int]:
    e = s.index("1", at)
    h = e - at
    left, width = 1 << (h * k), h * k + k - 1
    at = e + 1 + width
    m = int(s[e + 1 : at], 2) if width else 0
    if m < left:
        return m + left - 1, at
    return (m << 1) + (s[at] == "1") - 1, at + 1


def to_nat(n: int) -> int:
    """Signed to natural: 0, -1, 1, -2, 2 ... as 0, 1, 2, 3, 4."""
    return 2 * n if n >= 0 else -2 * n - 1


def from_nat(n: int) -> int:
    return n >> 1 if n % 2 == 0 else -((n + 1) >> 1)
