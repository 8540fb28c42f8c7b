"""Company demand signals over active listings (see listing_facts)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import has_salary
from hirelens.operators.active import UNKNOWN, listing_facts, since
from hirelens.operators.roles_report import top_k
from hirelens.schemas import Tables


def _limited(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    out = rows.orderBy(*order)
    return out if limit is None else out.limit(limit)


def active_summary(facts: DataFrame, as_of: datetime) -> DataFrame:
    return facts.agg(
        F.count("*").alias("active_listings"),
        F.count_if(since("first_seen_at", as_of, 7)).alias("new_7_days"),
        F.count_if(since("first_seen_at", as_of, 30)).alias("new_30_days"),
        F.count_distinct("company").alias("companies"),
        F.count_distinct("family_id").alias("families"),
    )


def company_signals(t: Tables, facts: DataFrame, as_of: datetime, limit: int | None = 10) -> DataFrame:
    """Per company: active and new listings, change against the week before, families, disclosure."""
    own = facts.groupBy("company").agg(
        F.count("*").alias("active"),
        F.count_if(since("first_seen_at", as_of, 7)).alias("new_7_days"),
        F.count_if(since("first_seen_at", as_of, 30)).alias("new_30_days"),
        F.count_distinct("family_label").alias("families"),
        (F.count_if(has_salary()) / F.count("*")).alias("disclosure_rate"),
    )
    every = listing_facts(t, t.listings.where(F.col("job_id").isNotNull() & since("first_seen_at", as_of, 14) & ~since("first_seen_at", as_of, 7)))
    before = every.groupBy("company").agg(F.count("*").alias("previous_new"))
    rows = own.join(before, "company", "left").fillna(0, ["previous_new"]).withColumn("delta", F.col("new_7_days") - F.col("previous_new"))
    rows = rows.join(top_k(facts, ["company"], "family_label", 5, "top_families"), "company", "left")
    return _limited(rows, [F.col("company") == UNKNOWN, F.desc("active"), F.desc("new_7_days"), F.desc("families"), F.asc("company")], limit)


def company_role_matrix(facts: DataFrame, limit: int | None = 50) -> DataFrame:
    rows = facts.groupBy("company", "family_id", "family_label").agg(F.count("*").alias("active"))
    return _limited(rows, [F.col("company") == UNKNOWN, F.desc("active"), F.asc("company"), F.asc("family_id")], limit)


def new_listings(t: Tables, as_of: datetime, days: int = 7, limit: int | None = 10) -> DataFrame:
    rows = listing_facts(t, t.listings.where(F.col("job_id").isNotNull() & since("first_seen_at", as_of, days)))
    return _limited(rows.groupBy("company").agg(F.count("*").alias("new_listings")), [F.col("company") == UNKNOWN, F.desc("new_listings"), F.asc("company")], limit)


def hiring_breadth(facts: DataFrame, limit: int | None = 10) -> DataFrame:
    rows = facts.groupBy("company").agg(F.count_distinct("family_id").alias("families"), F.count("*").alias("active"))
    return _limited(rows, [F.col("company") == UNKNOWN, F.desc("families"), F.desc("active"), F.asc("company")], limit)
