"""Folders that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While set, the shuffle files of a query go when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset a folder of the warehouse, which a cluster shares too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder."""
    return f"{shared_base(spark)}/hirelens-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Lets DataFrame.checkpoint() work where no folder for it was set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries written inside leave no shuffle files: what they wrote is read instead."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """df written to a shared folder (a new one by default) and read again: worked out once, whatever reads it, and not lost with an executor."""
    path = path or shared_dir(df.sparkSession)
    with cleaned(df.sparkSession):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of kept() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
