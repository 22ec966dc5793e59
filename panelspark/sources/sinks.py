"""Table sinks and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where none is named, one of this application in the warehouse.

    Both are shared by the driver and all executors, so that no intermediate table is on one machine's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None) or "spark-warehouse"
    return f"{warehouse.rstrip('/')}/_settled-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is dropped when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute once, as a table in the shared folder: for a frame that several branches of a plan read.

    The copy outlives lost executors, its columns are pruned per reader and its size is known to the
    planner, so that joins choose broadcast by size.
    """
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def time_split(df: DataFrame, t: str, bounds: dict[str, tuple[str, str]], out: str = "split") -> DataFrame:
    """Chronological split by inclusive date bounds; rows outside all bounds are dropped."""
    c: Column = F.lit(None).cast("string")
    for name, (lo, hi) in bounds.items():
        c = F.when(F.col(t).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(name)).otherwise(c)
    return df.withColumn(out, c).where(F.col(out).isNotNull())
