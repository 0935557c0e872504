"""Edge lists in text: plain (``src dst [weight]``) and MatrixMarket coordinate files.

A path is one file, or a folder whose part files in the order of their names are the file. Rows keep
their place in it as ``row``, so a range of rows can be selected. The place comes from the row's
split, which is a range of bytes of one file, and its place there: one pass counts the rows of each
split, and the prefix sums of those few counts are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["_file", "_start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all part files, with the file and the byte that their split begins at."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    return spark.read.text(path).select("value", *place)


def _numbered(lines: DataFrame) -> DataFrame:
    """(row, value) of the lines in the order of the files' names; a task reads whole splits, each in its order."""
    marked = lines.withColumn("_id", F.monotonically_increasing_id())
    counts = marked.groupBy(*_SPLIT).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # one row for each split
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*_SPLIT, (before - F.col("_first")).alias("_base"))
    return marked.join(F.broadcast(base), _SPLIT).select((F.col("_base") + F.col("_id")).alias("row"), "value")


def _edges(rows: DataFrame, weighted: bool, first_id: int) -> DataFrame:
    field = F.split(F.trim("value"), r"\s+")
    cols = [(F.element_at(field, k + 1).cast("long") - first_id).alias(n) for k, n in enumerate(("src", "dst"))]
    return rows.select("row", *cols, *([F.element_at(field, 3).cast("long").alias("weight")] if weighted else []))


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, start_row: int = 0, end_row: int | None = None) -> DataFrame:
    """(row, src, dst[, weight]) of rows [start_row, end_row); None or -1 for the rest.

    Blank lines and lines that start with # or % are no rows.
    """
    rows = _numbered(_lines(spark, path).where(~F.col("value").rlike(r"^\s*([#%].*)?$")))
    kept = rows.where(F.col("row") >= start_row)
    return _edges(kept if end_row in (None, -1) else kept.where(F.col("row") < end_row), weighted, 0)


def read_matrix_market(spark: SparkSession, path: str, start_row: int = 0, end_row: int | None = None) -> tuple[DataFrame, int, int]:
    """(edges, vertices, entries) of a coordinate file; its ids start at 1, ours at 0.

    Fields ``pattern`` and ``integer`` are read; of a symmetric matrix, the stored half.
    """
    text = _lines(spark, path)
    banner = text.where(F.lower("value").startswith("%%matrixmarket")).limit(1).collect()
    kind = banner[0].value.lower().split() if banner else []
    if kind[1:3] != ["matrix", "coordinate"] or kind[3] not in ("pattern", "integer"):
        raise ValueError("not a MatrixMarket coordinate file of pattern or integer entries")
    rows = _numbered(text.where(~F.col("value").rlike(r"^\s*(%.*)?$")))
    size = [int(x) for x in rows.where("row = 0").first().value.split()]
    kept = rows.where(F.col("row") > start_row).withColumn("row", F.col("row") - 1)
    kept = kept if end_row in (None, -1) else kept.where(F.col("row") < end_row)
    return _edges(kept, kind[3] == "integer", 1), max(size[:2]), size[2]
