"""Spark data source ``csx``: compressed graphs as edge rows, in batch and as a stream.

Options: ``path`` (base path of the graph), ``graphType`` (wg400, wg800, wg404), ``blockEdges``
(edges of a partition), ``withWeights`` (false leaves the label stream of wg404 unread),
``sideDir`` (where indexes go if the graph's folder is read-only), ``maxBlocksInFlight`` and
``batchEdges`` (of a stream), ``loEdge`` and ``hiEdge`` (range of the edge order). Filters on ``src`` and ``edge_idx`` become a
range of the edge order, and only its blocks are read. Files are opened on the executors, so the
path must be on a file system that all of them mount.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from weftline.sources.bvgraph import LabelReader, Reader, index_files, label_index
from weftline.sources.properties import check_files

DEFAULT_BLOCK = 1 << 20


class EdgeBlock(InputPartition):
    """Edges [lo, hi) of the edge order."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Blocks:
    """What batch and stream readers share: indexes, ranges and decoding."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.base, self.type = options["path"], options.get("graphtype", "wg400").lower()
        self.graph = check_files(self.base, self.type)
        self.index = index_files(self.graph, options.get("sidedir"))
        self.weights = self.type == "wg404" and str(options.get("withweights", "true")).lower() == "true"
        vertices = os.path.getsize(self.index["csx"]) // 8 - 1
        self.labels = label_index(self.base, vertices, options.get("sidedir")) if self.weights else None
        self.block = int(options.get("blockedges", DEFAULT_BLOCK))
        if self.block < 1:
            raise ValueError("blockEdges must be at least 1")
        self.offsets = np.memmap(self.index["csx"], np.uint64, "r")
        self.lo, self.hi = int(options.get("loedge", 0)), min(int(options.get("hiedge", self.edges)), self.edges)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "offsets"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.offsets = np.memmap(self.index["csx"], np.uint64, "r")

    @property
    def edges(self) -> int:
        return int(self.offsets[-1])

    def cut(self, lo: int, hi: int) -> list[EdgeBlock]:
        return [EdgeBlock(a, min(a + self.block, hi)) for a in range(lo, hi, self.block)]

    def decode(self, part: EdgeBlock, rows: int = 1 << 17):
        """Record batches of the edges of one block."""
        first = int(np.searchsorted(self.offsets, part.lo, "right")) - 1
        last = int(np.searchsorted(self.offsets, part.hi, "left"))
        reader = Reader(self.graph, self.index)
        label = LabelReader(self.base, self.labels) if self.weights else None
        names = ["src", "edge_idx", "dst", *(["weight"] if label else [])]
        while first < last:  # about ``rows`` edges at once, one vertex at least
            most = int(np.searchsorted(self.offsets, self.offsets[first] + np.uint64(rows), "right")) - 1
            to = min(max(most, first + 1), first + rows, last)
            degree, dst = reader.successors(first, to)
            a, b = int(self.offsets[first]), int(self.offsets[to])
            if len(dst) != b - a:
                raise ValueError(f"{self.graph}: vertices {first} to {to} have {len(dst)} edges, the index says {b - a}")
            cols = [np.repeat(np.arange(first, to), degree), np.arange(a, b), dst, *([label.labels(first, to, degree)] if label else [])]
            lo, hi = max(part.lo, a), min(part.hi, b)
            for i in range(lo, hi, rows):
                yield pa.record_batch([pa.array(c[i - a : min(i + rows, hi) - a]) for c in cols], names)
            first = to


class CsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.blocks = _Blocks(options)

    def pushFilters(self, filters):
        """Takes range filters on src and edge_idx; returns the others."""
        b = self.blocks
        vertices = len(b.offsets) - 1

        def narrow(column: str, low: int | None, high: int | None) -> None:
            """Keep low <= column < high."""
            if column == "src":
                low = None if low is None else int(b.offsets[min(max(low, 0), vertices)])
                high = None if high is None else int(b.offsets[min(max(high, 0), vertices)])
            b.lo, b.hi = max(b.lo, low if low is not None else b.lo), min(b.hi, high if high is not None else b.hi)

        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            value = getattr(f, "value", None)
            if name not in ("src", "edge_idx") or isinstance(f, In) and not f.value or value is None:
                yield f
            elif isinstance(f, EqualTo):
                narrow(name, value, value + 1)
            elif isinstance(f, GreaterThan):
                narrow(name, value + 1, None)
            elif isinstance(f, GreaterThanOrEqual):
                narrow(name, value, None)
            elif isinstance(f, LessThan):
                narrow(name, None, value)
            elif isinstance(f, LessThanOrEqual):
                narrow(name, None, value + 1)
            elif isinstance(f, In):
                narrow(name, min(value), max(value) + 1)
                yield f  # the values between are left to Spark
            else:
                yield f

    def partitions(self):
        return self.blocks.cut(self.blocks.lo, self.blocks.hi) or [EdgeBlock(0, 0)]

    def read(self, partition):
        if partition.lo < partition.hi:
            yield from self.blocks.decode(partition)


class CsxStream(DataSourceStreamReader):
    """Decodes at most ``maxBlocksInFlight`` blocks at a time.

    A micro-batch has so many tasks at most, and a task decodes its blocks one after another. Without
    ``batchEdges`` a batch has one block for each task; with it, a batch goes on to about that many edges, so
    that the number of batches is not that of the blocks. The next batch is only planned when the last one's
    callback has returned, which is the back-pressure. A trigger that asks once (availableNow) would get the first blocks only, so
    with one the cursor has to be unbounded (maxBlocksInFlight = 0).
    """

    def __init__(self, options: dict):
        self.blocks = _Blocks(options)
        options = {k.lower(): v for k, v in options.items()}
        self.flight = int(options.get("maxblocksinflight", 0))
        self.step = self.blocks.block * max(self.flight, int(options.get("batchedges", 0)) // self.blocks.block) if self.flight else 0
        self.at = self.blocks.lo

    def initialOffset(self):
        return {"edge": self.blocks.lo}

    def latestOffset(self):
        b = self.blocks
        self.at = min(b.hi, self.at + self.step) if self.step else max(b.hi, b.lo)
        return {"edge": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["edge"])
        lo, hi, block = start["edge"], end["edge"], self.blocks.block
        run = block * max(1, -(-(hi - lo) // (block * self.flight))) if self.flight else block
        return [EdgeBlock(a, min(a + run, hi)) for a in range(lo, hi, run)]

    def read(self, partition):
        for one in self.blocks.cut(partition.lo, partition.hi):
            yield from self.blocks.decode(one)

    def commit(self, end):
        self.at = max(self.at, json.loads(end)["edge"] if isinstance(end, str) else end["edge"])


class CsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csx"

    def schema(self) -> str:
        got = {k.lower(): str(v).lower() for k, v in self.options.items()}
        weighted = got.get("graphtype") == "wg404" and got.get("withweights", "true") == "true"
        return "src long NOT NULL, edge_idx long NOT NULL, dst long NOT NULL" + (", weight long NOT NULL" if weighted else "")

    def reader(self, schema):
        return CsxReader(dict(self.options))

    def streamReader(self, schema):
        return CsxStream(dict(self.options))


def register(spark) -> None:
    """Makes the format known; may be called any number of times."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CsxSource)
