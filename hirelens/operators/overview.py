"""Dashboard bundles, pages and nested documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.html import sanitize_text
from hirelens.functions.text import has_salary, loose_midpoint
from hirelens.operators import demand, roles_report, salary, skills, trends
from hirelens.operators.active import active_jobs, active_listings, job_facts, listing_facts
from hirelens.schemas import Tables

SORTS = ("first_seen_at", "last_seen_at", "salary_midpoint", "title", "company")


def overview_kpis(t: Tables, facts: DataFrame, candidates: DataFrame, as_of: datetime, days: int | None = None) -> DataFrame:
    """One row: open jobs, listings, companies, skills, pending duplicates, disclosure rate and the active summary."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(active_jobs(t.jobs, as_of, days), "open_jobs"), one(t.listings, "all_listings"), one(t.companies, "all_companies"), one(t.skills, "skills"),
        one(candidates.where("status = 'pending'"), "pending_duplicates"),
        facts.agg(F.coalesce(F.try_divide(F.count_if(has_salary()), F.count("*")), F.lit(0.0)).alias("disclosure_rate")),
        demand.active_summary(facts, as_of),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def missing_counts(t: Tables) -> DataFrame:
    """Listings without a salary, and listings whose job has no skill."""
    skilled = t.job_skills.select("job_id").distinct()
    bare = t.listings.join(skilled, "job_id", "left_anti").agg(F.count("*").alias("without_skills"))
    return t.listings.agg(F.count_if(~has_salary()).alias("without_salary")).crossJoin(bare)  # one row each


def freshness(t: Tables) -> DataFrame:
    return t.listings.agg(F.max("last_seen_at").alias("last_seen_at"))


def default_trend_skill(t: Tables, as_of: datetime, explicit: str | None = None, family_id: str | None = None) -> DataFrame:
    """One row with the skill to show: the given one, else the family's top one, else the top one."""
    if explicit:
        return t.jobs.sparkSession.createDataFrame([(explicit,)], "skill string")
    if family_id is not None:
        jobs = job_facts(t).where(F.col("family_id") == family_id).select("job_id")
        own = skills.top_skills(t.with_(jobs=t.jobs.join(jobs, t.jobs["id"] == jobs["job_id"], "left_semi")), as_of, None, 1)
        if own.count():  # one row at most
            return own.select("skill")
    return skills.top_skills(t, as_of, None, 1).select("skill")


def recent_runs(runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit)


def run_health(runs: DataFrame) -> DataFrame:
    bad = (F.col("status") != "completed") | F.coalesce(F.col("error_message") != "", F.lit(False))
    return runs.agg(F.count("*").alias("runs"), F.count_if(bad).alias("unhealthy"), F.max_by(F.struct("id", "source", "status"), F.struct("started_at", "id")).alias("latest"))


def company_filter_view(companies: DataFrame, name: str | None = None, source: str | None = None, role: str | None = None) -> DataFrame:
    """Rows of top_hiring_companies by name part, source and role, with a health flag and a mark for the latest time seen."""
    out = companies
    if name:
        out = out.where(F.lower("company").contains(name.lower()))
    if source:
        out = out.where(F.exists("top_sources", lambda x: x["name"] == source))
    if role:
        out = out.where(F.exists("top_families", lambda x: x["name"] == role))
    health = F.when(F.col("job_count") == 0, "no_jobs").when(F.col("listing_count") == 0, "no_listings").otherwise("healthy")
    last = out.agg(F.max("latest_seen_at").alias("newest"))
    return out.withColumn("health", health).crossJoin(F.broadcast(last)).withColumn("is_newest", F.col("latest_seen_at") == F.col("newest")).drop("newest")  # last is one row


def list_jobs(view: DataFrame, sort_by: str = "last_seen_at", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of listing_view (after search_listings)."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}")
    key = F.coalesce(F.col(sort_by), F.lit(0.0)) if sort_by == "salary_midpoint" else F.col(sort_by)
    return view.orderBy(key.desc() if descending else key.asc(), "id").offset(offset).limit(limit)


def job_documents(t: Tables) -> DataFrame:
    """Jobs with company, family, plain text, skills and listings nested."""
    names = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill"))
    listed = t.job_skills.join(names, "skill_id").groupBy("job_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    midpoint = loose_midpoint("salary_min", "salary_max").alias("salary_midpoint")
    rows = t.listings.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("id", "source", midpoint))).alias("listings"))
    texts = t.jobs.select(F.col("id").alias("job_id"), sanitize_text("description_text").alias("text"))
    facts = job_facts(t).select("job_id", "title", "company_name", "family_id", "family_label", "closed_at")
    return facts.join(texts, "job_id").join(listed, "job_id", "left").join(rows, "job_id", "left")


def company_documents(t: Tables, jobs_each: int = 50) -> DataFrame:
    order = Window.partitionBy("company_id").orderBy("id")
    counts = t.jobs.groupBy("company_id").agg(F.count("*").alias("job_count"))
    first = t.jobs.where("company_id is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= jobs_each)
    jobs = first.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("id", "title"))).alias("jobs"))
    names = t.companies.select(F.col("id").alias("company_id"), "name", "industry")
    return names.join(counts, "company_id", "left").fillna(0, ["job_count"]).join(jobs, "company_id", "left")


def snapshot_report(t: Tables, as_of: datetime, days: int | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """Skill and salary reports over one shared set of active listings; unpersist `facts` when done."""
    active = active_listings(t, as_of, days)
    facts = listing_facts(t, active).persist()
    return {
        "facts": facts,
        "top_skills": skills.top_skills(t, as_of, days, limit), "skills_by_source": skills.skills_by_source(t, facts, limit), "skills_by_company": skills.skills_by_company(t, as_of, days, limit),
        "skills_by_role_keyword": skills.skills_by_role_keyword(t, as_of, days), "skill_coverage": skills.skill_coverage(t, facts),
        "salary_ranges": salary.salary_ranges(facts), "salary_coverage": salary.salary_coverage(facts), "salary_by_source": salary.salary_by_source(facts, limit), "salary_by_company": salary.salary_by_company(facts, limit),
        "salary_by_skill": salary.salary_by_skill(t, facts, limit), "salary_by_role_keyword": salary.salary_by_role_keyword(facts, limit=limit), "top_salary_listings": salary.top_salary_listings(facts, limit),
    }


def trend_report(t: Tables, as_of: datetime, weeks: int = 12, skill: str | None = None, family_id: str | None = None) -> dict[str, DataFrame]:
    shown = default_trend_skill(t, as_of, skill, family_id).first()
    active = active_listings(t, as_of)
    return {
        "skill_demand": trends.skill_demand(t, shown["skill"] if shown else "", as_of, weeks), "salary_trend": trends.salary_trend(t, as_of, weeks, family_id),
        "posting_velocity": trends.posting_velocity(t, as_of, weeks, family_id), "company_velocity": trends.company_velocity(t, as_of, weeks, family_id, 50),
        "time_to_close": trends.time_to_close(t, family_id), "role_families": roles_report.role_family_summaries(t, active, as_of), "top_skills": skills.top_skills(t, as_of, None, 20),
    }


def demand_report(t: Tables, as_of: datetime, days: int = 7, limit: int = 10) -> dict[str, DataFrame]:
    facts = listing_facts(t, active_listings(t, as_of)).persist()
    return {
        "facts": facts, "summary": demand.active_summary(facts, as_of), "companies": demand.company_signals(t, facts, as_of, limit), "matrix": demand.company_role_matrix(facts, limit * 5),
        "new_listings": demand.new_listings(t, as_of, days, limit), "breadth": demand.hiring_breadth(facts, limit),
    }
