"""Streams of posting observations: landed polls to weekly active counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelens.operators import bitmaps

OBSERVATION = "run_id string, source string, source_job_id string, job_id long, observed_at timestamp, is_active boolean"


def read_observations(spark: SparkSession, path: str, schema: str = OBSERVATION) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_observations(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """One observation of a posting in a run, within the watermark."""
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["run_id", "source", "source_job_id"])


def weekly_active(stream: DataFrame) -> DataFrame:
    """(week, jobs): about how many distinct jobs were active per ISO week; a stream can't count them exactly, see weekly_exact."""
    week = F.window("observed_at", "7 days", "7 days", "4 days")  # Monday to Monday
    counts = stream.where("is_active").groupBy(week.alias("w")).agg(F.approx_count_distinct("job_id").alias("jobs"))
    return counts.select(F.col("w.start").cast("date").alias("week"), "jobs")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a batch function, such as one that calls ingest, on what has landed, then stops."""
    return stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_exact(observations: DataFrame) -> DataFrame:
    """The exact counts over stored observations, for foreachBatch."""
    rows = observations.where("is_active").select(F.date_trunc("week", "observed_at").cast("date").alias("week"), "job_id").distinct()
    return rows.groupBy("week").agg(F.count("*").alias("jobs"))


def follow_weekly(spark: SparkSession, landing: str, table: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Takes in what has landed since the last call and adds each micro-batch's bitmaps of active jobs by week to the table.

    Observations of (run, source, posting) count once within the watermark; those behind it are dropped. A micro-batch that is
    repeated after a failure replaces its own folder, so nothing counts twice. job_id is a job's number (see operators.bitmaps).
    """

    def add(df: DataFrame, batch: int) -> None:
        rows = df.where("is_active and job_id is not null").select(F.date_trunc("week", "observed_at").cast("date").alias("week"), F.col("job_id").alias("number"))
        bitmaps.bitmaps_of(rows, ["week"]).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return each_batch(distinct_observations(read_observations(spark, landing), delay), add, checkpoint)


def weekly_of(table: DataFrame) -> DataFrame:
    """(week, jobs): exact counts of the stored bitmaps."""
    return bitmaps.counts_of(table, ["week"], "jobs")
