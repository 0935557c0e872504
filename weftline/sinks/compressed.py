"""Compressed graphs written by tasks: ranges of vertices are encoded on their own and joined at bit positions.

Edges are dealt by ranges of sources and sorted there. A task encodes whole vertices, about
``SLICE`` edges at once, into piece files in the shared folder; the driver gets the lengths of
the pieces, one row each, and their prefix sums are the bit positions. Tasks then shift the
pieces and write the bytes that they fill alone, and the driver joins those that pieces share.
A vertex is encoded whole, so a hub's memory is that of its edges.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.sinks.binary import put
from weftline.sources import bitvec
from weftline.sources.bvgraph import encode_vertices, write_label_properties, write_properties

#: Edges that are encoded at once, and vertices that a piece spans at most.
SLICE, SPAN = 1 << 18, 1 << 20

#: What a vertex without edges has in .graph, .offsets, .labels and .labeloffsets.
_EMPTY = ("1", "010", "", "1")


def _slices(batches, columns: list[str], slice_edges: int):
    """The sorted rows in runs of whole sources, about ``slice_edges`` long, none over a multiple of SPAN."""

    def cut(cols: list[np.ndarray]):
        at = [0, *(np.flatnonzero(np.diff(cols[0] // SPAN)) + 1).tolist(), len(cols[0])]
        for a, b in zip(at, at[1:], strict=False):
            if b > a:
                yield [c[a:b] for c in cols]

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(batch.column(c)) for c in columns])
        n += batch.num_rows
        if n >= slice_edges and held[0][0][0] != held[-1][0][-1]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            to = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from cut([c[:to] for c in cols])
            held = [[c[to:] for c in cols]]
            n -= to
    if held:
        yield from cut([np.concatenate(c) for c in zip(*held, strict=True)])


def _parts(cols: list[np.ndarray], window: int, max_references: int, min_interval: int, k: int) -> list[tuple[bytes, int]]:
    """The bits of a run of sources in each file of the graph."""
    src, dst = cols[:2]
    first = int(src[0])
    degree = np.bincount(src - first)
    raw, bits = encode_vertices(first, degree, dst, window, max_references, min_interval, k)
    out = [(raw, int(bits.sum())), bitvec.pack(*bitvec.gamma_codes(bits))]
    if len(cols) > 2:
        value, width = bitvec.gamma_codes(cols[2])
        out += [bitvec.pack(value, width), bitvec.pack(*bitvec.gamma_codes(np.bincount(src - first, width).astype(np.int64)))]
    return out


def place(file: int, raw: bytes, size: int, at: int) -> list[tuple[int, int]]:
    """Writes ``size`` bits from bit position ``at`` on; gives (position, value) of bytes that are filled in part."""
    if not size:
        return []
    shift, start = at % 8, at // 8
    bits = np.frombuffer(raw, np.uint8)
    out = np.zeros(-(-(shift + size) // 8), np.uint8)
    out[: len(bits)] = bits >> shift
    if shift:
        high = (bits << (8 - shift)).astype(np.uint8)[: len(out) - 1]
        out[1 : 1 + len(high)] |= high
    a, b = int(shift > 0), len(out) - int((at + size) % 8 > 0)
    if a < b:
        put(file, out[a:b].tobytes(), start + a)
    ends = {0} if a else set()
    return [(start + i, int(out[i])) for i in sorted(ends | ({len(out) - 1} if b < len(out) else set()))]


def write_compressed(links: DataFrame, vertices: int, base: str, window: int = 7, labels: str | None = None, max_references: int = 3, min_interval: int = 4, k: int = 3, slice_edges: int = SLICE) -> int:
    """Writes .graph, .offsets and .properties of rows (src, dst[, weight]), each pair once; returns the edges.

    ``labels`` is the base of the labelled graph that holds the weights, in gamma codes. The paths must be on a
    file system that driver and executors mount.
    """
    columns = ["src", "dst", *(["weight"] if labels else [])]
    files = [f"{base}.graph", f"{base}.offsets", *([f"{labels}.labels", f"{labels}.labeloffsets"] if labels else [])]
    folder = f"{base}.pieces-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def encode(batches):
        for cols in _slices(batches, columns, slice_edges):
            parts, name = _parts(cols, window, max_references, min_interval, k), uuid.uuid4().hex
            with open(f"{folder}/{name}", "wb") as f:
                f.writelines(raw for raw, _ in parts)
            row = [pa.array([v]) for v in (int(cols[0][0]), int(cols[0][-1]) + 1, len(cols[0]), name, [n for _, n in parts])]
            yield pa.record_batch(row, ["first", "last", "edges", "name", "bits"])

    def join(batches):
        for batch in batches:
            for name, count, bits, at in zip(*(batch.column(c).to_pylist() for c in ("name", "count", "bits", "at")), strict=True):
                shared, byte = [], 0
                for i, path in enumerate(files):
                    if name:
                        raw = np.fromfile(f"{folder}/{name}", np.uint8, -(-bits[i] // 8), offset=byte).tobytes()
                        byte += len(raw)
                    else:
                        raw = np.packbits(np.tile(np.array([*map(int, _EMPTY[i])], np.uint8), count)).tobytes()
                    with open(path, "r+b", buffering=0) as f:
                        shared += [(i, *end) for end in place(f.fileno(), raw, bits[i], at[i])]
                if shared:
                    yield pa.record_batch([pa.array(c) for c in zip(*shared, strict=True)], ["file", "byte", "value"])

    try:
        ordered = links.select(*columns).repartitionByRange("src").sortWithinPartitions("src", "dst")
        pieces = sorted(ordered.mapInArrow(encode, "first long, last long, edges long, name string, bits array<long>").collect())
        at, jobs, v = [0, 1, 0, 1], [], 0  # the lists of positions begin with that of vertex 0, which is 0 and takes a bit

        def add(name: str, count: int, bits: list[int]) -> None:
            jobs.append((name, count, bits, at[: len(files)]))
            at[: len(files)] = [a + n for a, n in zip(at, bits, strict=False)]

        for p in [*pieces, None]:
            first = vertices if p is None else p.first
            if first < v or p is not None and p.last > vertices:
                raise ValueError(f"sources must be below {vertices}, and each in one piece")
            for a in range(v, first, SPAN):
                n = min(SPAN, first - a)
                add("", n, [n * len(code) for code in _EMPTY[: len(files)]])
            if p is not None:
                add(p.name, 0, p.bits)
                v = p.last
        for i, path in enumerate(files):
            with open(path, "wb") as f:
                f.truncate(-(-at[i] // 8))
        ends: dict[tuple[int, int], int] = defaultdict(int)
        for i in range(1, len(files), 2):
            ends[i, 0] = 128
        if jobs:
            spark = links.sparkSession
            parts = min(len(jobs), spark.sparkContext.defaultParallelism)
            rows = spark.createDataFrame(spark.sparkContext.parallelize(jobs, parts), "name string, count long, bits array<long>, at array<long>")
            for r in rows.mapInArrow(join, "file long, byte long, value long").collect():
                ends[r.file, r.byte] |= r.value
        for i, path in enumerate(files):
            with open(path, "r+b", buffering=0) as f:
                for (k_file, byte), value in ends.items():
                    if k_file == i:
                        put(f.fileno(), bytes([value]), byte)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    edges = sum(p.edges for p in pieces)
    write_properties(base, vertices, edges, window, max_references, min_interval, k)
    if labels:
        write_label_properties(labels, base, None)
    return edges
