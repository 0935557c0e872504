"""The order-sensitive validation sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.unsigned import wrap_u64
from weftline.operators.layout import CHUNK_BITS


def validation_sum(edges: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """One row ``validation_sum``: the number of edges plus, for each edge, (dst + 1) times the
    previous neighbour of its vertex plus one (or the vertex plus one at its first edge), modulo 2**64.

    The previous edge is found in ranges of the edge order, and across their borders by a join
    with one row for each range, so a vertex with very many edges needs no single task.
    """
    width = 1 << bits
    rows = edges.select("src", "edge_idx", "dst", F.shiftright("edge_idx", bits).alias("_chunk"))
    tails = rows.where(F.col("edge_idx") % width == width - 1).select((F.col("_chunk") + 1).alias("_chunk"), F.col("src").alias("_ts"), F.col("dst").alias("_td"))
    order = Window.partitionBy("_chunk").orderBy("edge_idx")
    near = rows.select("_chunk", "src", "dst", F.lag("src").over(order).alias("_ps"), F.lag("dst").over(order).alias("_pd"))
    both = near.join(tails, "_chunk", "left").select("src", "dst", F.coalesce("_ps", "_ts").alias("ps"), F.coalesce("_pd", "_td").alias("pd"))
    before = F.when(F.col("ps") == F.col("src"), F.col("pd") + 1).otherwise(F.col("src") + 1)
    term = before.cast("decimal(19,0)") * (F.col("dst") + 1).cast("decimal(19,0)") + F.lit(1).cast("decimal(19,0)")
    return both.agg(F.coalesce(wrap_u64(F.sum(term)), F.lit(0).cast("decimal(20,0)")).alias("validation_sum"))
