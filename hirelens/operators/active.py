"""Which jobs and listings are active, and the flat views that reports share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.roles import resolve_family
from hirelens.functions.sections import sections_of_listing
from hirelens.functions.text import annualized_midpoint, closed_midpoint, filled, loose_midpoint, normalize_text
from hirelens.schemas import Tables

UNKNOWN = "UNKNOWN"


def since(column: str | Column, as_of: datetime, days: int | None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.lit(True) if days is None else c >= F.lit(as_of) - F.expr(f"interval {int(days)} days")


def active_jobs(jobs: DataFrame, as_of: datetime, days: int | None = None) -> DataFrame:
    return jobs.where(F.col("closed_at").isNull() & since("last_seen_at", as_of, days))


def latest_activity(observations: DataFrame) -> DataFrame:
    """(source_listing_id, active): any active row at the latest time makes a listing active."""
    latest = F.max(F.struct("observed_at", "is_active"))
    return observations.groupBy("source_listing_id").agg(latest.getField("is_active").alias("active"))


def active_listings(t: Tables, as_of: datetime, days: int | None = None) -> DataFrame:
    """Listings of open jobs whose latest observation is active, or that have none."""
    opened = t.jobs.where(F.col("closed_at").isNull()).select(F.col("id").alias("job_id"))
    seen = latest_activity(t.observations).withColumnRenamed("source_listing_id", "seen_id")
    kept = t.listings.where(since("last_seen_at", as_of, days)).join(opened, "job_id", "left_semi")
    return kept.join(seen, kept["id"] == seen["seen_id"], "left").where(F.coalesce("active", F.lit(True))).select(*t.listings.columns)


def job_facts(t: Tables) -> DataFrame:
    """Per job: job_id, company_name (null if unknown), family_id, family_label, title, normalized_title and times."""
    names = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    family = resolve_family("role_family_id", "title")
    return t.jobs.join(names, "company_id", "left").select(F.col("id").alias("job_id"), "company_id", "company_name", family.alias("family"), "title", "normalized_title", F.col("first_seen_at").alias("job_first_seen_at"), F.col("last_seen_at").alias("job_last_seen_at"), "closed_at", F.col("location").alias("job_location"), F.col("canonical_url").alias("job_url"), F.col("role_family_id").alias("stored_family_id")).withColumns({"family_id": F.col("family.id"), "family_label": F.col("family.label")}).drop("family")


def company_of_listing() -> Column:
    return F.coalesce("company_name", "source_company_name", F.lit(UNKNOWN))


def listing_facts(t: Tables, listings: DataFrame) -> DataFrame:
    """Listings with their job's company and family, salary measures and company; the shared input of reports."""
    midpoint = closed_midpoint("salary_min", "salary_max")
    joined = listings.join(job_facts(t), "job_id", "left")
    return joined.withColumns({"company": company_of_listing(), "midpoint": midpoint, "annualized": annualized_midpoint("salary_min", "salary_max", "salary_interval")})


def listing_view(t: Tables, listings: DataFrame) -> DataFrame:
    """The flat listing row, with fallbacks from job to listing."""
    joined = listings.join(job_facts(t), "job_id", "left")
    family = F.coalesce("family_id", resolve_family(F.lit(None).cast("string"), "source_title")["id"])
    return joined.select(
        "id", "source", "source_job_id", "job_id",
        F.coalesce("title", "source_title").alias("title"),
        F.coalesce("company_name", "source_company_name").alias("company"),
        F.coalesce("job_location", "location").alias("location"),
        family.alias("role_family"), "workplace_type", "text_quality",
        "salary_min", "salary_max", loose_midpoint("salary_min", "salary_max").alias("salary_midpoint"), "salary_currency", "salary_interval",
        F.coalesce("source_url", "canonical_url", "job_url").alias("url"),
        sections_of_listing("raw_payload", "description_text").alias("sections"),
        "first_seen_at", "last_seen_at", "source_updated_at", "description_text",
    )


def search_listings(view: DataFrame, source: str | None = None, role_family: str | None = None, q: str | None = None) -> DataFrame:
    """Rows of listing_view by source, family, and a normalised substring of title, company or description."""
    out = view
    if source is not None:
        out = out.where(F.col("source") == source)
    if role_family is not None:
        out = out.where(F.col("role_family") == role_family)
    needle = " ".join((q or "").lower().split())
    if needle:
        has = lambda c: F.coalesce(normalize_text(c).contains(needle), F.lit(False))
        out = out.where(has("title") | has("company") | has("description_text"))
    return out


def family_company(t: Tables, listings: DataFrame) -> DataFrame:
    """(job_id, first name among a job's listings), for jobs without a company."""
    named = listings.where(filled("source_company_name").isNotNull())
    return named.groupBy("job_id").agg(F.min_by(filled("source_company_name"), "id").alias("listing_company"))
