"""Weekly trends. Weeks are ISO weeks, shown by their Mondays; the last is the week of as_of."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelens.functions.text import annualized_midpoint, delta_percent, normalize_text, week_start
from hirelens.operators.active import UNKNOWN
from hirelens.schemas import Tables


def week_bounds(as_of: datetime, weeks: int) -> tuple[datetime, datetime]:
    if weeks < 1:
        raise ValueError("weeks must be at least 1")
    monday = datetime(as_of.year, as_of.month, as_of.day) - timedelta(days=as_of.weekday())
    return monday - timedelta(weeks=weeks - 1), monday + timedelta(weeks=1)


def week_spine(spark: SparkSession, as_of: datetime, weeks: int) -> DataFrame:
    start, end = week_bounds(as_of, weeks)
    return spark.range(1).select(F.explode(F.sequence(F.lit(start.date()), F.lit((end - timedelta(weeks=1)).date()), F.expr("interval 7 days"))).alias("week"))


def in_window(column: str, as_of: datetime, weeks: int):
    start, end = week_bounds(as_of, weeks)
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def with_deltas(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("week")
    out = rows.withColumn("previous", F.lag(value).over(order))
    return out.withColumn("delta", F.col(value) - F.col("previous")).withColumn("delta_percent", delta_percent(F.col(value), F.col("previous")))


def _weekly_jobs(t: Tables, as_of: datetime, weeks: int) -> DataFrame:
    """Distinct (week, job_id) with an active observation; reduced by listing first."""
    seen = t.observations.where(F.col("is_active") & in_window("observed_at", as_of, weeks)).select(week_start("observed_at").alias("week"), F.col("source_listing_id").alias("id")).distinct()
    return seen.join(t.listings.select("id", "job_id").where("job_id is not null"), "id").select("week", "job_id").distinct()


def skill_demand_all(t: Tables, as_of: datetime, weeks: int = 12) -> DataFrame:
    """Distinct jobs per week and skill, zero weeks kept, with changes from week to week."""
    names = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill"))
    pairs = t.job_skills.join(names, "skill_id").select("job_id", "skill").distinct()
    counts = _weekly_jobs(t, as_of, weeks).join(pairs, "job_id").groupBy("skill", "week").agg(F.count("*").alias("job_count"))
    grid = names.select("skill").distinct().crossJoin(F.broadcast(week_spine(t.jobs.sparkSession, as_of, weeks)))  # weeks is a parameter
    full = grid.join(counts, ["skill", "week"], "left").fillna(0, ["job_count"])
    return with_deltas(full, "job_count", ["skill"])


def skill_demand(t: Tables, skill: str, as_of: datetime, weeks: int = 12) -> DataFrame:
    needle = " ".join(skill.lower().split())
    return skill_demand_all(t.with_(skills=t.skills.where(normalize_text("name") == needle)), as_of, weeks)


def salary_trend(t: Tables, as_of: datetime, weeks: int = 12, family_id: str | None = None) -> DataFrame:
    """Per week the mean over jobs of the annualised midpoint; the last observation of a week speaks for a job."""
    seen = t.observations.where(F.col("is_active") & in_window("observed_at", as_of, weeks)).select(week_start("observed_at").alias("week"), "observed_at", F.col("id").alias("observation"), "source_listing_id")
    jobs = t.jobs if family_id is None else t.jobs.where(F.col("role_family_id") == family_id)
    listings = t.listings.select(F.col("id").alias("source_listing_id"), "job_id", annualized_midpoint("salary_min", "salary_max", "salary_interval").alias("annual")).where("annual is not null")
    rows = seen.join(listings, "source_listing_id").join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    by_job = rows.groupBy("week", "job_id").agg(F.max_by("annual", F.struct("observed_at", "observation")).alias("annual"))
    weekly = by_job.groupBy("week").agg(F.count("*").alias("job_count"), F.avg("annual").alias("average_annualized"))
    return week_spine(t.jobs.sparkSession, as_of, weeks).join(weekly, "week", "left").fillna(0, ["job_count"]).orderBy("week")


def posting_velocity(t: Tables, as_of: datetime, weeks: int = 12, family_id: str | None = None) -> DataFrame:
    """Jobs first seen and jobs closed per week."""
    jobs = t.jobs if family_id is None else t.jobs.where(F.col("role_family_id") == family_id)
    count = lambda c, name: jobs.where(in_window(c, as_of, weeks)).groupBy(week_start(c).alias("week")).agg(F.count("*").alias(name))
    spine = week_spine(t.jobs.sparkSession, as_of, weeks)
    return spine.join(count("first_seen_at", "new_jobs"), "week", "left").join(count("closed_at", "closed_jobs"), "week", "left").fillna(0).orderBy("week")


def company_velocity(t: Tables, as_of: datetime, weeks: int = 12, family_id: str | None = None, limit: int | None = None) -> DataFrame:
    jobs = t.jobs if family_id is None else t.jobs.where(F.col("role_family_id") == family_id)
    counts = jobs.where(in_window("first_seen_at", as_of, weeks)).groupBy(week_start("first_seen_at").alias("week"), "company_id").agg(F.count("*").alias("new_jobs"))
    names = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    out = counts.join(names, "company_id", "left").withColumn("company", F.coalesce("company", F.lit(UNKNOWN))).orderBy("week", F.desc("new_jobs"), "company")
    return out if limit is None else out.limit(limit)


def company_velocity_totals(velocity: DataFrame) -> DataFrame:
    weeks = F.sort_array(F.collect_list(F.struct("week", "new_jobs"))).alias("weeks")
    return velocity.groupBy("company").agg(F.sum("new_jobs").alias("total"), weeks).orderBy(F.desc("total"), "company")


def time_to_close(t: Tables, family_id: str | None = None) -> DataFrame:
    """Closed jobs: count, median and 75th percentile of days from first seen to closed."""
    jobs = t.jobs if family_id is None else t.jobs.where(F.col("role_family_id") == family_id)
    days = (F.unix_micros("closed_at") - F.unix_micros("first_seen_at")) / 86_400_000_000
    counted = jobs.where(F.col("closed_at").isNotNull() & F.col("first_seen_at").isNotNull()).groupBy(days.alias("days")).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("closed_count"), F.percentile("days", F.lit(0.5), F.col("n")).alias("median_days"), F.percentile("days", F.lit(0.75), F.col("n")).alias("p75_days"))
