"""From an edge table to the offsets-and-edges layout, without a single-task sort.

Offsets are a prefix sum in two phases: sums of fixed ranges of vertices, a running sum over those
few, and a running sum inside each range. Positions inside a vertex are ranked per range of
neighbours, so that a vertex with very many edges is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vertices, neighbours or edges that one window partition spans.
CHUNK_BITS = 20


def prefix_sum(rows: DataFrame, key: str, value: str, out: str, bits: int = CHUNK_BITS) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of the dense non-negative ``key``."""
    chunk = F.shiftright(F.col(key), bits)
    sums = rows.groupBy(chunk.alias("_chunk")).agg(F.sum(value).alias("_total"))
    # one row for each 2**bits keys
    base = sums.select("_chunk", F.coalesce(F.sum("_total").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_chunk", chunk).join(base, "_chunk").withColumn(out, (F.col("_base") + inside).cast("long")).drop("_chunk", "_base")


def out_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, degree) of every vertex; those without edges have zero."""
    counts = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return vertices.join(counts, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, in_degree) of every vertex; those that no edge reaches have zero."""
    counts = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("in_degree"))
    return vertices.join(counts, "v", "left").select("v", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def offsets(degrees: DataFrame) -> DataFrame:
    """(v, offset): exclusive prefix sums of the degrees, and a last row with the totals."""
    body = prefix_sum(degrees, "v", "degree", "offset").select("v", "offset")
    last = degrees.agg(F.count("*").alias("v"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("offset"))
    return body.unionByName(last)


def degrees_of(offset_rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """First difference of offsets: (v, degree), without the last row's vertex."""
    following = offset_rows.select((F.col("v") - 1).alias("v"), F.col("offset").alias("next"))
    return offset_rows.join(following, "v").select("v", (F.col("next") - F.col("offset")).alias("degree"))


def indexed(edges: DataFrame, vertices: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """The edges with ``edge_idx``, their position in the order of (src, dst).

    The edges are shuffled once in full, by source and range of neighbours; everything
    else works on counts.
    """
    order = ["dst", *(["weight"] if "weight" in edges.columns else [])]
    parted = edges.withColumn("_part", F.shiftright("dst", bits))
    counts = parted.groupBy("src", "_part").agg(F.count("*").alias("_n"))
    within = counts.select("src", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    degree = counts.groupBy(F.col("src").alias("v")).agg(F.sum("_n").alias("degree"))
    every = vertices.join(degree, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))
    start = prefix_sum(every, "v", "degree", "_offset", bits).select(F.col("v").alias("src"), "_offset")
    base = within.join(start, "src").select("src", "_part", (F.col("_offset") + F.col("_before")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("src", "_part").orderBy(*order)) - 1
    return parted.join(base, ["src", "_part"]).withColumn("edge_idx", (F.col("_base") + rank).cast("long")).select("src", "edge_idx", *[c for c in edges.columns if c != "src"])


def histogram(rows: DataFrame, value: str, out: str = "degree", count: str = "cnt") -> DataFrame:
    """How many rows have each value; values that no row has do not appear."""
    return rows.groupBy(F.col(value).alias(out)).agg(F.count("*").alias(count))
