"""Files of consecutive 64-bit integers, and parallel scans of them: the storage benchmark."""

from __future__ import annotations

import mmap
import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("mmap", "pread", "read")
#: Reads past the page cache: blocks must be multiples of this, and the file system must support it.
DIRECT, ALIGNED = "direct", 4096


def write_sequence(spark: SparkSession, path: str, n: int, block: int = 1 << 20) -> None:
    """Value i at position i; blocks are written by tasks at their own place in the file."""
    with open(path, "wb") as f:
        f.truncate(8 * n)

    def write(batches):
        for batch in batches:
            for start in batch.column("id").to_pylist():
                with open(path, "r+b") as f:
                    f.seek(8 * start)
                    f.write(np.arange(start, min(start + block, n), dtype="<u8").tobytes())
            yield batch

    spark.range(0, n, block).mapInArrow(write, "id long").count()


def scan_blocks(spark: SparkSession, path: str, block_bytes: int = 4 << 20, method: str = "mmap", partitions: int | None = None) -> DataFrame:
    """(block, bytes, total, seconds) of every block of the file, read by one of METHODS."""
    if method not in (*METHODS, DIRECT):
        raise ValueError(f"method must be one of {(*METHODS, DIRECT)}")
    if method == DIRECT and block_bytes % ALIGNED:
        raise ValueError(f"blocks of direct reads must be multiples of {ALIGNED} bytes")
    size = os.path.getsize(path)

    def read(batches):
        opener = (lambda name, flags: os.open(name, flags | os.O_DIRECT)) if method == DIRECT else None
        with open(path, "rb", buffering=0, opener=opener) as f:
            aligned = mmap.mmap(-1, block_bytes) if method == DIRECT else None
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if method == "mmap" and size else None
            for batch in batches:
                rows = []
                for b in batch.column("id").to_pylist():
                    began, a, n = time.perf_counter_ns(), b * block_bytes, min(block_bytes, size - b * block_bytes)
                    if view is not None:
                        raw = view[a : a + n]
                    elif method == "pread":
                        raw = os.pread(f.fileno(), n, a)
                    elif aligned is not None:
                        raw = memoryview(aligned)[: os.preadv(f.fileno(), [aligned], a)]
                    else:
                        f.seek(a)
                        raw = f.read(n)
                    total = int(np.frombuffer(raw, "<u8").sum(dtype=np.uint64))
                    rows.append((b, n, total, (time.perf_counter_ns() - began) / 1e9))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.decimal128(20), pa.float64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.decimal128(20), pa.float64())], ["block", "bytes", "total", "seconds"])

    return spark.range(0, -(-size // block_bytes), 1, partitions).mapInArrow(read, "block long, bytes long, total decimal(20,0), seconds double")


def forget_cached(spark: SparkSession, path: str) -> None:
    """Asks every machine that gets a task to drop the file's pages from its page cache."""

    def forget(batches):
        for batch in batches:
            with open(path, "rb") as f:
                os.fsync(f.fileno())
                os.posix_fadvise(f.fileno(), 0, 0, os.POSIX_FADV_DONTNEED)
            yield batch

    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(forget, "id long").count()


def bandwidth(spark: SparkSession, path: str, block_bytes: int, method: str, partitions: int, rounds: int = 3, cold: bool = False) -> dict:
    """Minimum and maximum MB/s over rounds, MB/s over the mean time, mean load imbalance in percent, and whether
    the sum was right in each round (it is always checked). ``cold`` drops the file from the page cache before each."""
    n, rates, idle, whole = os.path.getsize(path) // 8, [], [], 0.0
    right = True
    for _ in range(rounds):
        if cold:
            forget_cached(spark, path)
        began = time.perf_counter_ns()
        part = F.spark_partition_id().alias("p")
        got = scan_blocks(spark, path, block_bytes, method, partitions).groupBy(part).agg(F.sum("total").alias("t"), F.sum("seconds").alias("s")).collect()
        took = (time.perf_counter_ns() - began) / 1e9
        busy = [r.s for r in got] + [0.0] * (partitions - len(got))
        whole += took
        rates.append(8 * n / took / 1e6)
        idle.append(100 * (1 - sum(busy) / len(busy) / max(max(busy), 1e-9)))
        right &= sum(int(r.t) for r in got) % (1 << 64) == (n * (n - 1) // 2) % (1 << 64)
    return {"min": min(rates), "avg": 8 * n * rounds / whole / 1e6, "max": max(rates), "imbalance": sum(idle) / rounds, "right": right}


def sweep(spark: SparkSession, path: str, block_sizes: list[int], partitions: list[int], methods: tuple[str, ...] = METHODS, rounds: int = 3, cold: bool = True) -> list[dict]:
    """Bandwidths for every combination of block size, number of parallel readers and method."""
    return [{"block_bytes": b, "partitions": p, "method": m, **bandwidth(spark, path, b, m, p, rounds, cold)} for b in block_sizes for p in partitions for m in methods]
