"""Binary graph files written block by block at computed positions.

The file is made at its full size first; tasks then write their values at the byte position that
the edge order gives. Blocks may land in any order and a task that runs again writes the same
bytes at the same place. The path must be on a file system that driver and executors
mount. All values are little-endian.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.unsigned import narrow_u32


def _prepare(path: str, size: int, header: list[int]) -> None:
    with open(path, "wb") as f:
        f.write(np.array(header, "<u8").tobytes())
        f.truncate(size)


def put(file: int, data: bytes, position: int) -> None:
    """Writes all of the data: a single call may write less."""
    left = memoryview(data)
    while left:
        done = os.pwrite(file, left, position)
        left, position = left[done:], position + done


def write_at(rows: DataFrame, path: str, position: str, values: list[str], start: int, dtype: str) -> int:
    """Writes ``values`` of each row from byte start + position * row size on; returns the rows written."""

    def write(batches):
        n = 0
        with open(path, "r+b", buffering=0) as f:
            for batch in batches:
                at = np.asarray(batch.column(position))
                if not len(at):
                    continue
                data = np.stack([np.asarray(batch.column(v)) for v in values], 1).astype(dtype)
                order = np.argsort(at, kind="stable")
                at, data = at[order], data[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
                for a, b in zip(cuts, cuts[1:], strict=False):
                    put(f.fileno(), data[a:b].tobytes(), start + int(at[a]) * data.shape[1] * data.itemsize)
                n += len(at)
        yield pa.record_batch([pa.array([n])], ["n"])

    ordered = rows.select(position, *values).repartitionByRange(position).sortWithinPartitions(position)
    return ordered.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _offsets_and_edges(edges: DataFrame, offsets: DataFrame, vertices: int, count: int, path: str, header: list[int]) -> None:
    start = 8 * len(header)
    _prepare(path, start + 8 * (vertices + 1) + 4 * count, header)
    write_at(offsets, path, "v", ["offset"], start, "<u8")
    written = write_at(edges.select("edge_idx", narrow_u32(F.col("dst"), "dst").alias("dst")), path, "edge_idx", ["dst"], start + 8 * (vertices + 1), "<u4")
    if written != count:
        raise RuntimeError(f"{written} of {count} edges written")


def write_csx(edges: DataFrame, offsets: DataFrame, vertices: int, count: int, path: str) -> None:
    """u64 V, u64 E, u64 offsets[V + 1], u32 dst[E]; ids of 8 bytes are narrowed under a check."""
    if vertices > 1 << 32:
        raise ValueError("more than 2**32 vertices do not fit 4-byte ids")
    _offsets_and_edges(edges, offsets, vertices, count, path, [vertices, count])


def write_g3(edges: DataFrame, offsets: DataFrame, vertices: int, count: int, path: str, link: bool = True) -> None:
    """Eight u64 (3, 1, V, E, 4, 8, 0, 0), u64 offsets[V + 1], u32 dst[E], and a .sg link beside it."""
    _offsets_and_edges(edges, offsets, vertices, count, path, [3, 1, vertices, count, 4, 8, 0, 0])
    if link:
        real = os.path.realpath(path)
        short = real[:-7] + ".sg"
        if os.path.lexists(short):
            os.unlink(short)
        os.symlink(real, short)


def write_weighted(edges: DataFrame, count: int, path: str) -> None:
    """(u32 dst, u32 weight)[E] without a header."""
    _prepare(path, 8 * count, [])
    write_at(edges.select("edge_idx", narrow_u32(F.col("dst"), "dst").alias("dst"), F.col("weight").bitwiseAND(F.lit(0xFFFFFFFF)).alias("weight")), path, "edge_idx", ["dst", "weight"], 0, "<u4")


def write_offsets(offsets: DataFrame, vertices: int, path: str) -> None:
    """u64 offsets[V + 1]."""
    _prepare(path, 8 * (vertices + 1), [])
    write_at(offsets, path, "v", ["offset"], 0, "<u8")


def read_words(spark: SparkSession, path: str, layout: list[tuple[int, str]], block: int = 1 << 20) -> DataFrame:
    """(pos, value) of every number in a file; ``layout`` has (how many, dtype) of each section."""
    sections, byte, pos, jobs = [], 0, 0, []
    for n, dtype in layout:
        sections.append((byte, pos, n, dtype))
        jobs += [(len(sections) - 1, a, min(a + block, n)) for a in range(0, n, block)]
        byte += n * np.dtype(dtype).itemsize
        pos += n

    def read(batches):
        for batch in batches:
            for s, a, b in zip(*(batch.column(c).to_pylist() for c in ("s", "a", "b")), strict=True):
                start, first, _, dtype = sections[s]
                got = np.fromfile(path, dtype, b - a, offset=start + a * np.dtype(dtype).itemsize)
                yield pa.record_batch([pa.array(np.arange(first + a, first + b)), pa.array(got.astype(np.int64))], ["pos", "value"])

    return spark.createDataFrame(jobs or [(0, 0, 0)], "s int, a long, b long").mapInArrow(read, "pos long, value long")
