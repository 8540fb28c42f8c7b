"""Role family and hiring company summaries. Each grain is aggregated by itself, then joined on the key."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.roles import CUSTOM, FAMILIES, OTHER, OTHER_LABEL
from hirelens.functions.text import filled
from hirelens.operators.active import UNKNOWN, active_jobs, family_company, job_facts
from hirelens.operators.skills import skill_names
from hirelens.schemas import Tables
from hirelens.sources.shared import kept


def top_k(rows: DataFrame, key: list[str], name: str, k: int, alias: str) -> DataFrame:
    """The k names with most rows for each key, as an array of (name, count)."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(*key, name).agg(F.count("*").alias("count"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("count"), name))).where(F.col("rank") <= k)
    items = F.sort_array(F.collect_list(F.struct("rank", F.col(name).alias("name"), "count")))
    return best.groupBy(*key).agg(F.transform(items, lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias(alias))


def _joined(frames: list[DataFrame], key: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), frames)


def _kept(t: Tables, listings: DataFrame, as_of: datetime, days: int | None, family_id: str | None) -> tuple[DataFrame, DataFrame]:
    """The columns of active jobs and of listings that reports group by, stored: several groupings read them."""
    jobs = job_facts(t.with_(jobs=active_jobs(t.jobs, as_of, days)))
    jobs = jobs if family_id is None else jobs.where(F.col("family_id") == family_id)
    return kept(jobs.select("job_id", "company_name", "family_id", "family_label", "title", "job_last_seen_at")), kept(listings.select("id", "job_id", "source", "source_company_name", "salary_min", "salary_max", "salary_interval", "last_seen_at"))


def role_family_summaries(t: Tables, listings: DataFrame, as_of: datetime, days: int | None = None, family_id: str | None = None, limit: int | None = 10) -> DataFrame:
    """Per family over active jobs and active listings. Jobs with their families, and listings, are each worked out once and kept as narrow frames."""
    jobs, listings = _kept(t, listings, as_of, days, family_id)
    rows = listings.join(jobs.select("job_id", "family_id"), "job_id")
    key = ["family_id"]
    named = jobs.join(family_company(t, listings), "job_id", "left").withColumn("who", F.coalesce(filled("company_name"), "listing_company"))
    by_job = named.groupBy(*key).agg(F.first("family_label").alias("family_label"), F.count("*").alias("job_count"), F.count_distinct("who").alias("company_count"))
    from hirelens.functions.text import annualized_midpoint, has_salary

    annual = annualized_midpoint("salary_min", "salary_max", "salary_interval")
    by_listing = rows.groupBy(*key).agg(F.count("*").alias("listing_count"), F.count_if(has_salary()).alias("salaried_count"), F.avg(annual).alias("average_annualized"))
    titles = jobs.groupBy(*key, "title").agg(F.min("job_id").alias("first_id"))
    titles = titles.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("first_id"))).where("rank <= 5")
    titles = titles.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("example_titles"))
    skills = top_k(jobs.select("job_id", *key).join(skill_names(t), "job_id"), key, "skill", 8, "top_skills")
    out = _joined([by_job, by_listing, top_k(rows, key, "source", 5, "top_sources"), skills, titles], key)
    out = out.fillna(0, ["listing_count", "salaried_count"]).orderBy(F.col("family_id") == OTHER, F.desc("job_count"), F.desc("listing_count"), "family_label")
    return out if limit is None else out.limit(limit)


def role_family_catalog(t: Tables, summaries: DataFrame, include_other: bool = True) -> DataFrame:
    """All known families, with zeros where there is nothing, then custom ones."""
    known = [(k, label) for k, (label, _) in FAMILIES.items()] + ([(OTHER, OTHER_LABEL)] if include_other else [])
    catalog = t.jobs.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(known)], "place int, family_id string, label string")
    counts = summaries.select("family_id", "family_label", "job_count", "listing_count", "company_count")
    zero = ["job_count", "listing_count", "company_count"]
    first = F.broadcast(catalog).join(counts.drop("family_label"), "family_id", "left").fillna(0, zero).select("place", "family_id", "label", *zero)
    custom = counts.where(F.col("family_id").startswith(CUSTOM)).select(F.lit(len(known)).alias("place"), "family_id", F.col("family_label").alias("label"), *zero)
    return first.unionByName(custom).orderBy("place", "label")


def top_hiring_companies(t: Tables, listings: DataFrame, as_of: datetime, days: int | None = None, family_id: str | None = None, limit: int | None = 10) -> DataFrame:
    """Per company over active jobs: jobs, active listings, latest time seen, top families and sources."""
    jobs, listings = _kept(t, listings, as_of, days, family_id)
    named = jobs.join(family_company(t, listings), "job_id", "left").withColumn("company", F.coalesce(filled("company_name"), "listing_company", F.lit(UNKNOWN)))
    rows = listings.select("job_id", "source", "last_seen_at").join(named.select("job_id", "company"), "job_id")
    key = ["company"]
    by_job = named.groupBy(*key).agg(F.count("*").alias("job_count"), F.max("job_last_seen_at").alias("job_seen"))
    by_listing = rows.groupBy(*key).agg(F.count("*").alias("listing_count"), F.max("last_seen_at").alias("listing_seen"))
    out = _joined([by_job, by_listing, top_k(named, key, "family_label", 5, "top_families"), top_k(rows, key, "source", 5, "top_sources")], key)
    out = out.fillna(0, ["listing_count"]).withColumn("latest_seen_at", F.greatest("job_seen", "listing_seen")).drop("job_seen", "listing_seen")
    out = out.orderBy(F.col("company") == UNKNOWN, F.desc("job_count"), F.desc("listing_count"), F.lower("company"))
    return out if limit is None else out.limit(limit)


def labels(array: str | Column) -> Column:
    """`name:count` items of a top-k array in one string, for flat output."""
    c = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["count"])), "; ")
