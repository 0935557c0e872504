"""Intermediate tables in the folder that the whole cluster shares.

Long plans are cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading
it back: unlike a local checkpoint it survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that set none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for local masters that set none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _local[app]


class Scratch:
    """Tables of one operator call. ``drop`` removes those that no later result reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` now and return a plain scan of what was written."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._weftline_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file bytes for scans. Sizes partitions, never decides results."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    except Exception:  # an estimate is optional
        return 1 << 30
