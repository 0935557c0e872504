"""Arrays as compact binary columns: sorted cells as deltas, flags as packed bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True) if raw else b""


def expand(blob: bytes) -> bytes:
    return _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True) if blob else b""


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 32-bit values: deltas, byte plane by byte plane."""
    if not len(values):
        return b""
    deltas = np.diff(values.astype(np.int64), prepend=0).astype("<u4")
    return squeeze(deltas.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(expand(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def pack_bits(flags: np.ndarray) -> bytes:
    return squeeze(len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()) if len(flags) else b""


def unpack_bits(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, bool)
    raw = expand(blob)
    return np.unpackbits(np.frombuffer(raw[8:], np.uint8), count=int.from_bytes(raw[:8], "little")).astype(bool)
