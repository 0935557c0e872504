"""Fixed-size blocks of the ordered edge sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.unsigned import block_of


def with_block(edges: DataFrame, block_edges: int, lo: int = 0) -> DataFrame:
    return edges.withColumn("block", block_of(F.col("edge_idx"), lo, block_edges))


def summary(edges: DataFrame, block_edges: int, lo: int = 0) -> DataFrame:
    """Edges, first and last source and, with weights, their sum, of each block."""
    sums = [F.sum("weight").alias("sum_w")] if "weight" in edges.columns else []
    return with_block(edges, block_edges, lo).groupBy("block").agg(F.count("*").alias("n"), F.min("src").alias("min_src"), F.max("src").alias("max_src"), *sums)


def bounds(edges: DataFrame, offset_rows: DataFrame, block_edges: int, lo: int = 0) -> DataFrame:
    """(block, start_vertex, start_edge, end_vertex, end_edge), half-open, of each block.

    The end is the last edge's vertex and the position behind that edge, so no block is empty
    and an exact multiple of the block size has no block behind it.
    """
    cut = with_block(edges, block_edges, lo).groupBy("block").agg(F.min(F.struct("edge_idx", "src")).alias("f"), F.max(F.struct("edge_idx", "src")).alias("l"))
    o = offset_rows.select("v", "offset")
    first, last = o.select(F.col("v").alias("fv"), F.col("offset").alias("fo")), o.select(F.col("v").alias("lv"), F.col("offset").alias("lo"))
    both = cut.join(first, F.col("f.src") == F.col("fv")).join(last, F.col("l.src") == F.col("lv"))
    return both.select("block", F.col("f.src").alias("start_vertex"), (F.col("f.edge_idx") - F.col("fo")).alias("start_edge"), F.col("l.src").alias("end_vertex"), (F.col("l.edge_idx") + 1 - F.col("lo")).alias("end_edge"))


def progress(edges: DataFrame, block_edges: int, lo: int = 0) -> DataFrame:
    """(block, edges_read): edges of all blocks so far; the window runs over blocks, not edges."""
    counts = with_block(edges, block_edges, lo).groupBy("block").agg(F.count("*").alias("n"))
    return counts.select("block", F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("edges_read"))
