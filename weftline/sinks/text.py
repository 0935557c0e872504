"""Text graph files: each has an order key, so writing is a range partitioning and local sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def el_lines(edges: DataFrame) -> DataFrame:
    """(pos, line): ``src dst`` in edge order."""
    return edges.select(F.col("edge_idx").alias("pos"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))


def adj_lines(edges: DataFrame, offsets: DataFrame, vertices: int, count: int) -> DataFrame:
    """(pos, line): a header of three lines, V offsets (not V + 1), then the E neighbours."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, "AdjacencyGraph"), (1, str(vertices)), (2, str(count))], "pos long, line string")
    body = offsets.where(F.col("v") < vertices).select((F.col("v") + 3).alias("pos"), F.col("offset").cast("string").alias("line"))
    tail = edges.select((F.col("edge_idx") + 3 + vertices).alias("pos"), F.col("dst").cast("string").alias("line"))
    return head.unionByName(body).unionByName(tail)


def pair_lines(rows: DataFrame, key: str, count: str) -> DataFrame:
    """(pos, line): ``key; count;`` in ascending order of the key, for histograms and component sizes."""
    return rows.select(F.col(key).alias("pos"), F.format_string("%d; %d;", F.col(key), F.col(count)).alias("line"))


def write_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Part files that, in the order of their names, hold the lines in order."""
    by = lines.repartitionByRange(partitions, "pos") if partitions else lines.repartitionByRange("pos")
    by.sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)
