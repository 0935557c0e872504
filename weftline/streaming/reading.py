"""Asynchronous reads: blocks of edges are delivered to a callback while the caller goes on."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.unsigned import block_count, block_of
from weftline.scratch import shared_dir

RUNNING, DONE, FAILED = 0, 1, -1


class ReadRequest:
    """A running read. ``status`` is DONE only when every block was read and its callback returned.

    A callback gets at most ``in_flight`` blocks, which are kept for its actions. With ``batch_edges`` it gets so
    many edges that are not kept: each of its actions decodes them anew, ``in_flight`` blocks at a time.
    """

    def __init__(self, spark: SparkSession, options: dict, lo: int, hi: int, block_edges: int, in_flight: int, callback: Callable[[DataFrame, int], None], batch_edges: int = 0):
        self.total_edges, self.total_blocks = hi - lo, block_count(hi - lo, block_edges)
        self.edges_read, self._began, self._ended = 0, time.monotonic(), None
        self.error: BaseException | None = None
        self._query, self._done = None, threading.Event()
        if not self.total_edges:
            self._done.set()
            return

        def deliver(batch: DataFrame, batch_id: int) -> None:
            if self._done.is_set():
                return
            # the block's number follows from the position, whatever batches they came in
            kept = batch.withColumn("block", block_of(F.col("edge_idx"), lo, block_edges))
            if not batch_edges:
                kept.persist()
            try:
                n = kept.count()
                if n:
                    callback(kept, batch_id)
                self.edges_read += n
                self._ended = time.monotonic()
            except BaseException as e:
                self.error = e
                raise
            finally:
                if not batch_edges:
                    kept.unpersist()
            if self.edges_read >= self.total_edges:
                self._done.set()

        stream = spark.readStream.format("csx").options(**options, loEdge=lo, hiEdge=hi, blockEdges=block_edges, maxBlocksInFlight=in_flight, batchEdges=batch_edges).load()
        self._query = stream.writeStream.foreachBatch(deliver).trigger(processingTime="0 seconds").option("checkpointLocation", f"{shared_dir(spark)}/weftline/stream-{uuid.uuid4().hex}").start()

    @property
    def status(self) -> int:
        if self._done.is_set():
            return DONE
        if self.error is not None or (self._query is not None and self._query.exception() is not None):
            return FAILED
        return RUNNING

    @property
    def progress(self) -> dict:
        """Status, edges delivered of all, all blocks, edges a second up to the last delivery, and the engine's last report."""
        seconds = (self._ended or time.monotonic()) - self._began
        last = self._query.lastProgress if self._query is not None else None
        return {"status": self.status, "edges_read": self.edges_read, "total_edges": self.total_edges, "total_blocks": self.total_blocks, "edges_per_s": self.edges_read / max(seconds, 1e-9), "last": last}

    def wait(self, timeout: float | None = None) -> ReadRequest:
        """Returns when all callbacks are done; raises what a block's read or callback raised."""
        waited = 0.0
        while not self._done.wait(0.05):
            waited += 0.05
            if self.status == FAILED:
                raise RuntimeError("the read failed") from (self.error or self._query.exception())
            if timeout is not None and waited > timeout:
                raise TimeoutError(f"{self.edges_read} of {self.total_edges} edges after {timeout} s")
        self.release()
        return self

    def release(self) -> None:
        if self._query is not None:
            self._query.stop()
