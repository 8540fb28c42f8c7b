"""Writers: the listing export and the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT = ("id", "source", "source_job_id", "job_id", "title", "company", "location", "role_family", "workplace_type", "text_quality", "salary_min", "salary_max", "salary_midpoint", "salary_currency", "salary_interval", "url", "sections", "first_seen_at", "last_seen_at", "source_updated_at", "description_text")


def export_rows(view: DataFrame) -> DataFrame:
    """The flat columns of listing_view, newest first; the sections as JSON."""
    return view.withColumn("sections", F.to_json("sections")).select(*EXPORT).orderBy(F.desc("last_seen_at"), "id")


def export_listings_csv(view: DataFrame, path: str) -> None:
    export_rows(view).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces the table, or with partition_by only the partitions that df has rows of, so that a repeated run changes nothing."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
