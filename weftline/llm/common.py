"""Column helpers and bounded training samples shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def bounded_sample(rows: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hash of ``key``: the same whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(bound)


def rows_of(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``, a bounded sample and so small enough to broadcast."""
    return docs.join(F.broadcast(ids), key)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in any spelling of upper and lower case."""
    taken, k = {c.lower() for c in df.columns}, 0
    while (out := f"weftline_{name}_{k}") in taken:
        k += 1
    return out


def modest_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Lets Arrow batches of this session hold at most ``limit`` bytes (Spark's default is 64 MB), so that the
    buffers of a task stay small on both sides; a smaller setting is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > limit or int(now) <= 0:
        spark.conf.set(key, str(limit))
