"""The Graph handle: metadata, offsets, sub-graph reads and analytics over one edge layout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.unsigned import adaptive_block_edges, block_count
from weftline.operators import blocks as block_ops
from weftline.operators import layout
from weftline.operators.checksum import validation_sum
from weftline.operators.components import components
from weftline.operators.requests import RejectedRequest, edge_range
from weftline.sources import datasource
from weftline.sources.bvgraph import index_files
from weftline.sources.properties import check_files, read_properties

#: Exclusive upper bounds of the block size by graph type.
MOST_BLOCK_EDGES = {"wg400": 1 << 29, "wg404": 1 << 28, "wg800": 1 << 28}


class Graph:
    """A graph from compressed files (``open``) or from any edge table (``from_edges``)."""

    uses_own_buffers = True
    uses_user_arrays = False

    def __init__(self, spark: SparkSession, graph_type: str, path: str | None = None):
        self.spark, self.graph_type, self.path = spark, graph_type, path
        self.max_blocks_in_flight = spark.sparkContext.defaultParallelism
        self._edges = self._offsets = self._vertices = None
        self._order: int | None = None
        self._count: int | None = None
        self._block_edges: int | None = None
        self.options: dict[str, str] = {}
        self._index: dict[str, str] | None = None
        self._requests: list = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, graph_type: str = "wg400", **options) -> Graph:
        """Reads metadata only; missing files and unknown types raise."""
        datasource.register(spark)
        self = cls(spark, graph_type.lower(), path)
        base = check_files(path, self.graph_type)
        self._properties = read_properties(base)
        self._order, self._count = int(self._properties["nodes"]), int(self._properties["arcs"])
        if "blockEdges" in options:
            self.block_edges = int(options.pop("blockEdges"))
        self.max_blocks_in_flight = int(options.pop("maxBlocksInFlight", self.max_blocks_in_flight))
        if self.max_blocks_in_flight < 1:
            raise ValueError("at least one block must be in flight")
        self.options = {"path": path, "graphType": self.graph_type, **options}
        self._base = base
        return self

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | int) -> Graph:
        """A graph of rows (src, dst[, weight]); vertices are 0 to V - 1, as a count or as rows (v)."""
        spark = edges.sparkSession
        self = cls(spark, "wg404" if "weight" in edges.columns else "wg800")
        self._vertices = spark.range(vertices).select(F.col("id").alias("v")) if isinstance(vertices, int) else vertices
        self._raw = edges
        return self

    # metadata and options

    @property
    def num_vertices(self) -> int:
        if self._order is None:
            self._order = self._vertices.count()
        return self._order

    @property
    def num_edges(self) -> int:
        if self._count is None:
            self._count = self._raw.count()
        return self._count

    @property
    def block_edges(self) -> int:
        return self._block_edges or adaptive_block_edges(self.num_edges)

    @block_edges.setter
    def block_edges(self, n: int) -> None:
        if not 1 <= n < MOST_BLOCK_EDGES[self.graph_type]:
            raise ValueError(f"block size {n} is out of range for {self.graph_type}")
        self._block_edges = n

    def vertex_weights(self):
        raise NotImplementedError("no graph type has vertex weights")

    def release(self) -> None:
        """Ends reads that are still running and forgets the handle's tables. Index files stay beside the graph."""
        for request in self._requests:
            request.release()
        self._requests.clear()
        self._edges = self._offsets = self._index = None

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    # rows

    @property
    def vertices(self) -> DataFrame:
        if self._vertices is None:
            self._vertices = self.spark.range(self.num_vertices).select(F.col("id").alias("v"))
        return self._vertices

    @property
    def index(self) -> dict[str, str]:
        if self._index is None:
            self._index = index_files(self._base, self.options.get("sideDir"))
        return self._index

    @property
    def edges(self) -> DataFrame:
        """(src, edge_idx, dst[, weight])."""
        if self._edges is None:
            self._edges = self.spark.read.format("csx").options(**self.options, blockEdges=min(self.block_edges, 1 << 22)).load() if self.path else layout.indexed(self._raw, self.vertices)
        return self._edges

    @property
    def links(self) -> DataFrame:
        """The edges without their position, which spares ``from_edges`` graphs the ordering."""
        return self.edges.drop("edge_idx") if self.path else self._raw

    @property
    def degrees(self) -> DataFrame:
        return layout.degrees_of(self.offset_rows()) if self.path else layout.out_degree(self._raw, self.vertices)

    def offset_rows(self) -> DataFrame:
        """(v, offset) with V + 1 rows."""
        if self._offsets is None:
            if self.path:
                from weftline.sinks.binary import read_words

                self._offsets = read_words(self.spark, self.index["csx"], [(self.num_vertices + 1, "<u8")]).select(F.col("pos").alias("v"), F.col("value").alias("offset"))
            else:
                self._offsets = layout.offsets(self.degrees)
        return self._offsets

    def offsets(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Offsets of [start, end], both included; None or -1 stands for V."""
        end = self.num_vertices if end is None or end == -1 else end
        if start < 0 or start > self.num_vertices or end > self.num_vertices or start > end:
            raise RejectedRequest(f"offsets {start} to {end} of {self.num_vertices} vertices")
        return self.offset_rows().where(F.col("v").between(start, end))

    def edge_range(self, sv: int = 0, se: int = 0, ev: int | None = None, ee: int | None = None) -> tuple[int, int]:
        """[lo, hi) of a request. At most four offsets are looked up."""
        none = lambda x: None if x is not None and x < 0 else x
        ev, ee = none(ev), none(ee)
        v = self.num_vertices
        if self.path:
            table = np.memmap(self.index["csx"], np.uint64, "r")
            at = lambda x: int(table[min(x, v)])
        else:
            want = sorted({x for x in (sv, sv + 1, v, *([] if ev is None else (ev, ev + 1))) if 0 <= x <= v})
            got = {r.v: r.offset for r in self.offset_rows().where(F.col("v").isin(want)).collect()}
            at = lambda x: got[min(x, v)]
        return edge_range(at, v, sv, se, ev, (1 << 62) if ee is None and ev is not None and ev < v else ee)

    def subgraph(self, sv: int = 0, se: int = 0, ev: int | None = None, ee: int | None = None) -> DataFrame:
        """The edges of a request, read synchronously; only its blocks are decoded."""
        lo, hi = self.edge_range(sv, se, ev, ee)
        # the range of vertices follows from that of edges, but can be pushed below the ranking of a graph from rows
        inside = (F.col("src") >= sv) if ev is None or ev < 0 else F.col("src").between(sv, ev)
        return self.edges.where(inside & (F.col("edge_idx") >= lo) & (F.col("edge_idx") < hi))

    def read_async(self, callback: Callable[[DataFrame, int], None], sv: int = 0, se: int = 0, ev: int | None = None, ee: int | None = None, batch_edges: int = 0):
        """Delivers the request's blocks to ``callback(batch, batch_id)`` in the background.

        A batch has at most ``max_blocks_in_flight`` blocks, which a callback may collect. Callbacks that work on
        the executors can take about ``batch_edges`` edges at once, of which no more blocks are decoded at a time.
        """
        from weftline.streaming.reading import ReadRequest

        if not self.path:
            raise ValueError("asynchronous reads need a graph that was opened from files")
        if callback is None:
            raise RejectedRequest("a callback is needed")
        lo, hi = self.edge_range(sv, se, ev, ee)
        request = ReadRequest(self.spark, self.options, lo, hi, self.block_edges, self.max_blocks_in_flight, callback, batch_edges)
        self._requests.append(request)
        return request

    def total_callbacks(self, lo: int, hi: int) -> int:
        return block_count(hi - lo, self.block_edges)

    # analytics

    def in_degrees(self) -> DataFrame:
        return layout.in_degree(self.links, self.vertices)

    def in_degree_distribution(self) -> DataFrame:
        return layout.histogram(self.in_degrees(), "in_degree")

    def components(self) -> DataFrame:
        return components(self.vertices, self.links)

    def validation_sum(self) -> DataFrame:
        return validation_sum(self.edges)

    def block_summary(self, block_edges: int | None = None) -> DataFrame:
        return block_ops.summary(self.edges, block_edges or self.block_edges)

    def map_blocks(self, f, schema: str, block_edges: int | None = None) -> DataFrame:
        """``f`` on the rows of each block, as a pandas table with the column ``block``."""
        return block_ops.with_block(self.edges, block_edges or self.block_edges).groupBy("block").applyInPandas(f, schema)
