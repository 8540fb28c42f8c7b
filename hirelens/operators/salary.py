"""Salary reports over active listings (see listing_facts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import has_salary
from hirelens.operators.active import UNKNOWN
from hirelens.operators.ranks import exact_percentiles
from hirelens.operators.skills import TITLE_KEYWORDS, keyword_array
from hirelens.schemas import Tables


def salary_ranges(facts: DataFrame) -> DataFrame:
    """Per currency and interval: ranges, averages and annualised quartiles of the listings that name a salary.

    Rows are counted by value first, so the exact percentile merges a small histogram.
    """
    keys = [F.coalesce("salary_currency", F.lit(UNKNOWN)).alias("currency"), F.coalesce("salary_interval", F.lit("unspecified")).alias("interval")]
    counted = facts.where(has_salary()).groupBy(*keys, "salary_min", "salary_max", "midpoint", "annualized").agg(F.count("*").alias("n"))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n"))))
    share = lambda p: F.percentile("annualized", F.lit(p), F.col("n"))
    return counted.groupBy("currency", "interval").agg(
        F.sum("n").alias("posting_count"), F.min("salary_min").alias("salary_min"), F.max("salary_max").alias("salary_max"),
        mean("salary_min").alias("average_min"), mean("salary_max").alias("average_max"), mean("midpoint").alias("average_midpoint"), mean("annualized").alias("average_annualized"),
        share(0.25).alias("p25"), share(0.5).alias("median"), share(0.75).alias("p75"),
        F.coalesce(F.sum(F.when(F.col("midpoint").isNotNull(), F.col("n"))), F.lit(0)).alias("closed_count"),
    ).orderBy("currency", "interval", F.desc("posting_count"))


def salary_coverage(facts: DataFrame) -> DataFrame:
    """Listings, those with a salary and the rate, per source and (source null, all_sources) for all, in one pass."""
    out = facts.rollup("source").agg(F.grouping("source").alias("all_sources"), F.count("*").alias("total"), F.count_if(has_salary()).alias("with_salary"))
    return out.withColumn("rate", F.coalesce(F.try_divide("with_salary", "total"), F.lit(0.0)))


def salary_by(facts: DataFrame, segments: Column, limit: int | None = 10) -> DataFrame:
    """Annualised count, mean and quartiles per segment; segments is an array, a row counts in each."""
    counted = facts.where(F.col("annualized").isNotNull()).select("annualized", F.explode(segments).alias("segment")).groupBy("segment", "annualized").agg(F.count("*").alias("n"))
    share = lambda p: F.percentile("annualized", F.lit(p), F.col("n"))
    rows = counted.groupBy("segment").agg(F.sum("n").alias("listing_count"), (F.sum(F.col("annualized") * F.col("n")) / F.sum("n")).alias("average"), share(0.25).alias("p25"), share(0.5).alias("median"), share(0.75).alias("p75"))
    ordered = rows.orderBy(F.desc("average"), F.desc("listing_count"), "segment")
    return ordered if limit is None else ordered.limit(limit)


def salary_by_ranks(facts: DataFrame, segments: Column) -> DataFrame:
    """salary_by without a limit, for segments of any size: quartiles by ranks in ranges of the values."""
    rows = facts.where(F.col("annualized").isNotNull()).select("annualized", F.explode(segments).alias("segment")).groupBy("segment", "annualized").agg(F.count("*").alias("n"))
    quartiles = exact_percentiles(rows, ["segment"], "annualized", {"p25": 0.25, "median": 0.5, "p75": 0.75}, "n")
    means = rows.groupBy("segment").agg((F.sum(F.col("annualized") * F.col("n")) / F.sum("n")).alias("average"))
    return quartiles.join(means, "segment").select("segment", F.col("count").alias("listing_count"), "average", "p25", "median", "p75")


def salary_by_source(facts: DataFrame, limit: int | None = 10) -> DataFrame:
    return salary_by(facts, F.array("source"), limit)


def salary_by_company(facts: DataFrame, limit: int | None = 10) -> DataFrame:
    return salary_by(facts, F.array("company"), limit)


def salary_by_role_keyword(facts: DataFrame, keywords: tuple[str, ...] = TITLE_KEYWORDS, limit: int | None = 10) -> DataFrame:
    return salary_by(facts, keyword_array("normalized_title", keywords), limit)


def salary_by_skill(t: Tables, facts: DataFrame, limit: int | None = 10) -> DataFrame:
    """A listing counts once for each job_skill row of its job."""
    names = t.job_skills.join(t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill")), "skill_id").select("job_id", "skill")
    return salary_by(facts.where(F.col("annualized").isNotNull()).select("job_id", "annualized").join(names, "job_id"), F.array("skill"), limit)


def top_salary_listings(facts: DataFrame, limit: int = 10) -> DataFrame:
    rows = facts.where(F.col("annualized").isNotNull()).select(F.col("id").alias("listing_id"), "source", "company", F.coalesce("title", "source_title").alias("title"), F.coalesce("source_url", "canonical_url", "job_url").alias("url"), "annualized", "salary_currency", "salary_interval")
    return rows.orderBy(F.desc("annualized"), "listing_id").limit(limit)
