"""Skill reports over active jobs and listings. Limits are features of these reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.operators.active import UNKNOWN, active_jobs
from hirelens.schemas import Tables

TITLE_KEYWORDS = ("data", "engineer", "analyst", "software", "product")


def skill_names(t: Tables) -> DataFrame:
    """Distinct (job_id, skill) by skill name."""
    names = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill"))
    return t.job_skills.join(names, "skill_id").select("job_id", "skill").distinct()


def _active_ids(t: Tables, as_of: datetime, days: int | None) -> DataFrame:
    return active_jobs(t.jobs, as_of, days).select(F.col("id").alias("job_id"), "company_id", "normalized_title")


def top_skills(t: Tables, as_of: datetime, days: int | None = None, limit: int | None = 10) -> DataFrame:
    rows = skill_names(t).join(_active_ids(t, as_of, days), "job_id").groupBy("skill").agg(F.count("*").alias("job_count"))
    return _first(rows, [F.desc("job_count"), F.asc("skill")], limit)


def _first(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def skills_by_source(t: Tables, listings: DataFrame, limit: int | None = 50) -> DataFrame:
    """Active listings per source and skill."""
    rows = listings.select("id", "source", "job_id").join(skill_names(t), "job_id").groupBy("source", "skill").agg(F.count("*").alias("listing_count"))
    return _first(rows, [F.asc("source"), F.desc("listing_count"), F.asc("skill")], limit)


def skills_by_company(t: Tables, as_of: datetime, days: int | None = None, limit: int | None = 50) -> DataFrame:
    names = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    jobs = _active_ids(t, as_of, days).join(names, "company_id", "left").select("job_id", F.coalesce("company", F.lit(UNKNOWN)).alias("company"))
    rows = skill_names(t).join(jobs, "job_id").groupBy("company", "skill").agg(F.count("*").alias("job_count"))
    return _first(rows, [F.asc("company"), F.desc("job_count"), F.asc("skill")], limit)


def keyword_array(title: str, keywords: tuple[str, ...] = TITLE_KEYWORDS):
    """The keywords that a title contains, as an array, in their order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col(title), k))


def skills_by_role_keyword(t: Tables, as_of: datetime, days: int | None = None, keywords: tuple[str, ...] = TITLE_KEYWORDS, limit: int = 5) -> DataFrame:
    jobs = _active_ids(t, as_of, days).select("job_id", F.explode(keyword_array("normalized_title", keywords)).alias("keyword"))
    rows = jobs.join(skill_names(t), "job_id").groupBy("keyword", "skill").agg(F.count("*").alias("job_count"))
    best = Window.partitionBy("keyword").orderBy(F.desc("job_count"), "skill")
    place = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("keyword"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).orderBy(place, "rank")


def skill_coverage(t: Tables, listings: DataFrame) -> DataFrame:
    """Per source: listings, full texts, snippets, listings whose job has a skill, and the full-text rate."""
    skilled = t.job_skills.select("job_id").distinct().withColumn("skilled", F.lit(True))
    return listings.join(skilled, "job_id", "left").groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("text_quality") == "full_text").alias("full_text"),
        F.count_if(F.col("text_quality") == "snippet").alias("snippet"),
        F.count_if("skilled").alias("with_skills"),
    ).withColumn("full_text_rate", F.coalesce(F.try_divide("full_text", "total"), F.lit(0.0)))


def skills_for_title(t: Tables, keyword: str, limit: int = 10) -> DataFrame:
    """Skills of jobs, open or not, whose title has the keyword, by job_skill rows."""
    needle = keyword.replace("-", " ").lower()
    jobs = t.jobs.where(F.contains("normalized_title", F.lit(needle))).select(F.col("id").alias("job_id"))
    names = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill"))
    rows = t.job_skills.join(jobs, "job_id", "left_semi").join(names, "skill_id").groupBy("skill").agg(F.count("*").alias("rows"))
    return _first(rows, [F.desc("rows"), F.asc("skill")], limit)


def skill_documents(t: Tables, aliases: DataFrame, jobs_each: int = 20) -> DataFrame:
    """Per skill its aliases and its first jobs by id."""
    order = Window.partitionBy("skill_id").orderBy("job_id")
    pairs = t.job_skills.select("skill_id", "job_id").distinct()
    jobs = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= jobs_each)
    titles = t.jobs.select(F.col("id").alias("job_id"), "title")
    listed = jobs.join(titles, "job_id").groupBy("skill_id").agg(F.sort_array(F.collect_list(F.struct("job_id", "title"))).alias("jobs"))
    named = aliases.groupBy("skill_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return t.skills.select(F.col("id").alias("skill_id"), "name", "category").join(named, "skill_id", "left").join(listed, "skill_id", "left")
