"""Unsigned and block arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MASK = 0xFFFFFFFF
U64 = 1 << 64


def u32(c: Column) -> Column:
    """The low 32 bits as a non-negative long: reinterprets a signed weight, narrows an id."""
    return c.cast("long").bitwiseAND(F.lit(U32_MASK))


def narrow_u32(c: Column, name: str = "id") -> Column:
    """A long narrowed to 32 unsigned bits; ids that do not fit raise an error."""
    return F.when((c >= 0) & (c <= U32_MASK), c).otherwise(F.raise_error(F.concat(F.lit(f"{name} does not fit 4 bytes: "), c.cast("string"))).cast("long"))


def wrap_u64(c: Column) -> Column:
    """A sum of DECIMAL(38,0) modulo 2**64, as DECIMAL(20,0)."""
    return F.pmod(c.cast("decimal(38,0)"), F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def block_of(edge_idx: Column, lo: int | Column, block_edges: int) -> Column:
    """Number of the fixed-size block that an edge falls in."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    return F.floor((edge_idx - lo) / F.lit(block_edges)).cast("long")


def block_count(edges: int, block_edges: int) -> int:
    return -(-edges // block_edges) if edges > 0 else 0


def adaptive_block_edges(edges: int, default: int = 64 << 20) -> int:
    """Block size of small graphs: an eighth of the edges, as a power of two, at least 1024."""
    if 1024 < edges < default:
        return max(1024, 1 << ((edges.bit_length() - 1) - 3))
    return default
