"""Registered queries of the job-market library over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import html, roles, text
from hirelens.functions.sections import extract_sections
from hirelens.operators import active, archive, dedupe, demand, ingest, matching, overview, roles_report, salary, skills, trends
from hirelens.plans import adapters as A
from hirelens.plans.model_sql import MODEL
from hirelens.sources import normalize, sinks

AS_OF, WEEKS = A.AS_OF, 26
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, model: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (MODEL if model else "") + sql
        return f

    return add


def _facts(spark: SparkSession, d: str):
    t = A.tables(spark, d)
    return t, active.listing_facts(t, active.active_listings(t, AS_OF))


def r4(*columns: str) -> dict:
    return {c: F.round(c, 4) for c in columns}


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


# active sets

@query("select count(*) jobs, cast(sum(id) as bigint) id_sum from open_jobs where last_seen_at >= timestamp '2001-08-01' - interval 365 day")
def a1_active_jobs(spark, d):
    return active.active_jobs(A.jobs(spark, d), AS_OF, 365).agg(F.count("*").alias("jobs"), F.sum("id").alias("id_sum"))


@query("select id, job_id, source from active")
def a2_active_listings(spark, d):
    return active.active_listings(A.tables(spark, d), AS_OF).select("id", "job_id", "source")


_TEXT = "'responsibilities: keep system number ' || resp || ' of the platform running. requirements: ' || req || ' years of work with large tables.'"


@query(f"select id, coalesce(cname, source_company_name, 'UNKNOWN') company, fid role_family, 1 hit from every where source = 'lever' and (contains(ntitle, 'number 2 of') or contains({_TEXT}, 'number 2 of')) union all select id, coalesce(cname, source_company_name, 'UNKNOWN'), fid, 2 from every where contains(ntitle, 'data engineer') or contains({_TEXT}, 'data engineer')")
def a3_search_listings(spark, d):
    """By source and a part of the description, and by a part of the title."""
    t = A.tables(spark, d)
    view = active.listing_view(t, t.listings)
    rows = lambda n, *how: active.search_listings(view, *how).select("id", F.coalesce("company", F.lit("UNKNOWN")).alias("company"), "role_family", F.lit(n).alias("hit"))
    return rows(1, "lever", None, " NUMBER  2 of ").unionByName(rows(2, None, None, "Data Engineer"))


@query("select id, source, title, coalesce(cname, source_company_name) company, fid role_family, coalesce((salary_min + salary_max) / 2, salary_min, salary_max) salary_midpoint, 'keep system number ' || resp || ' of the platform running.' responsibilities from every")
def a4_listing_view(spark, d):
    t = A.tables(spark, d)
    return active.listing_view(t, t.listings).select("id", "source", "title", "company", "role_family", "salary_midpoint", F.col("sections")["responsibilities"].alias("responsibilities"))


# skills

@query("select skill, count(distinct job_id) job_count from js join open_jobs j on j.id = job_id group by 1 order by 2 desc, 1 limit 10")
def k1_top_skills(spark, d):
    return skills.top_skills(A.tables(spark, d), AS_OF)


@query("select source, skill, count(*) listing_count from active join js using (job_id) group by 1, 2")
def k2_skills_by_source(spark, d):
    t = A.tables(spark, d)
    return skills.skills_by_source(t, active.active_listings(t, AS_OF), None)


@query("select coalesce(c.name, 'UNKNOWN') company, skill, count(distinct job_id) job_count from js join open_jobs j on j.id = job_id left join companies c on c.id = company_id group by 1, 2")
def k3_skills_by_company(spark, d):
    return skills.skills_by_company(A.tables(spark, d), AS_OF, None, None)


@query("""select keyword, skill, job_count, rank from (select *, row_number() over (partition by keyword order by job_count desc, skill) as rank from
  (select keyword, skill, count(distinct job_id) job_count from js join open_jobs j on j.id = job_id join (select unnest(['data', 'engineer', 'analyst', 'software', 'product']) keyword) on contains(ntitle, keyword) group by 1, 2)) where rank <= 5""")
def k4_skills_by_role_keyword(spark, d):
    return skills.skills_by_role_keyword(A.tables(spark, d), AS_OF)


@query("""select source, count(*) total, count(*) filter (text_quality = 'full_text') full_text, count(*) filter (text_quality = 'snippet') snippet,
  count(*) filter (exists (select 1 from job_skills s where s.job_id = a.job_id)) with_skills, round(count(*) filter (text_quality = 'full_text') / count(*), 4) full_text_rate from active a group by 1""")
def k5_skill_coverage(spark, d):
    t = A.tables(spark, d)
    return skills.skill_coverage(t, active.active_listings(t, AS_OF)).withColumns(r4("full_text_rate"))


@query("select skill, count(*) as rows from js join jobs j on j.id = job_id where contains(ntitle, 'data engineer') group by 1 order by 2 desc, 1 limit 10")
def k6_skills_for_title(spark, d):
    return skills.skills_for_title(A.tables(spark, d), "data-engineer")


@query("""select skill name, string_agg(job_id, ',' order by job_id) jobs from (select skill, job_id, row_number() over (partition by skill order by job_id) n from js) where n <= 20 group by 1""")
def k7_skill_documents(spark, d):
    t = A.tables(spark, d)
    named = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("alias"))
    return skills.skill_documents(t, named).select("name", F.array_join(F.transform("jobs", lambda j: j["job_id"].cast("string")), ",").alias("jobs"))


# salaries

@query("""select coalesce(salary_currency, 'UNKNOWN') currency, coalesce(salary_interval, 'unspecified') as interval, count(*) posting_count, min(salary_min) salary_min, max(salary_max) salary_max,
  round(avg(salary_min), 4) average_min, round(avg(salary_max), 4) average_max, round(avg(midpoint), 4) average_midpoint, round(avg(annual), 4) average_annualized,
  round(quantile_cont(annual, 0.25), 4) p25, round(quantile_cont(annual, 0.5), 4) median, round(quantile_cont(annual, 0.75), 4) p75, count(midpoint) closed_count from facts where paid group by 1, 2""")
def p1_salary_ranges(spark, d):
    return salary.salary_ranges(_facts(spark, d)[1]).withColumns(r4("average_min", "average_max", "average_midpoint", "average_annualized", "p25", "median", "p75"))


@query("select count(*) total, count(*) filter (paid) with_salary, round(count(*) filter (paid) / count(*), 4) rate from facts")
def p2_salary_coverage(spark, d):
    return salary.salary_coverage(_facts(spark, d)[1]).where("all_sources = 1").select("total", "with_salary", F.round("rate", 4).alias("rate"))


@query("select source, count(*) total, count(*) filter (paid) with_salary, round(count(*) filter (paid) / count(*), 4) rate from facts group by 1")
def p3_salary_coverage_by_source(spark, d):
    return salary.salary_coverage(_facts(spark, d)[1]).where("all_sources = 0").select("source", "total", "with_salary", F.round("rate", 4).alias("rate"))


_SEGMENT = "count(*) listing_count, round(avg(annual), 4) average, round(quantile_cont(annual, 0.25), 4) p25, round(quantile_cont(annual, 0.5), 4) median, round(quantile_cont(annual, 0.75), 4) p75"


def _segments(df: DataFrame) -> DataFrame:
    return df.withColumns(r4("average", "p25", "median", "p75"))


@query(f"select source segment, {_SEGMENT} from facts where annual is not null group by 1")
def p4_salary_by_source(spark, d):
    return _segments(salary.salary_by_source(_facts(spark, d)[1], None))


@query(f"select company segment, {_SEGMENT} from facts where annual is not null group by 1")
def p5_salary_by_company(spark, d):
    return _segments(salary.salary_by_company(_facts(spark, d)[1], None))


@query(f"select skill segment, {_SEGMENT} from facts join js using (job_id) where annual is not null group by 1")
def p6_salary_by_skill(spark, d):
    t, facts = _facts(spark, d)
    return _segments(salary.salary_by_skill(t, facts, None))


@query(f"select keyword segment, {_SEGMENT} from facts join (select unnest(['data', 'engineer', 'analyst', 'software', 'product']) keyword) on contains(ntitle, keyword) where annual is not null group by 1")
def p7_salary_by_role_keyword(spark, d):
    return _segments(salary.salary_by_role_keyword(_facts(spark, d)[1], limit=None))


@query("select id listing_id, company, title, annual annualized from facts where annual is not null order by annual desc, id limit 10")
def p8_top_salary_listings(spark, d):
    return salary.top_salary_listings(_facts(spark, d)[1]).select("listing_id", "company", "title", "annualized")


# role families and companies

_FAMILY = """, fam_jobs as (select j.*, c.name cname from open_jobs j left join companies c on c.id = company_id),
named as (select j.id, j.fid, coalesce(j.cname, (select arg_min(source_company_name, a.id) from active a where a.job_id = j.id and source_company_name is not null)) who from fam_jobs j)
"""


@query(_FAMILY + """select fid family_id, any_value(flabel) family_label, count(*) job_count, (select count(distinct who) from named n where n.fid = j.fid) company_count,
  (select count(*) from facts f where f.fid = j.fid) listing_count, (select count(*) from facts f where f.fid = j.fid and paid) salaried_count, (select round(avg(annual), 4) from facts f where f.fid = j.fid) average_annualized,
  (select string_agg(source || ':' || n, '; ' order by n desc, source) from (select source, count(*) n from facts f where f.fid = j.fid group by 1 order by 2 desc, 1 limit 5)) top_sources,
  (select string_agg(skill || ':' || n, '; ' order by n desc, skill) from (select skill, count(*) n from fam_jobs g join js on js.job_id = g.id where g.fid = j.fid group by 1 order by 2 desc, 1 limit 8)) top_skills,
  (select string_agg(title, '; ' order by first_id) from (select title, min(id) first_id from fam_jobs g where g.fid = j.fid group by 1 order by 2 limit 5)) example_titles
  from fam_jobs j group by fid""")
def r1_role_family_summaries(spark, d):
    t = A.tables(spark, d)
    out = roles_report.role_family_summaries(t, active.active_listings(t, AS_OF), AS_OF, limit=None)
    return out.withColumns({"top_sources": roles_report.labels("top_sources"), "top_skills": roles_report.labels("top_skills"), "example_titles": F.array_join("example_titles", "; "), **r4("average_annualized")})


@query(_FAMILY + "select fid family_id, count(*) job_count, (select count(*) from facts f where f.fid = 'robotics') listing_count from fam_jobs where fid = 'robotics' group by 1")
def r2_role_family_detail(spark, d):
    t = A.tables(spark, d)
    return roles_report.role_family_summaries(t, active.active_listings(t, AS_OF), AS_OF, family_id="robotics").select("family_id", "job_count", "listing_count")


@query(_FAMILY + """select coalesce(k.tfid, j.fid) family_id, coalesce(j.n, 0) job_count, coalesce(j.m, 0) listing_count from (select distinct tfid from titles) k
  full join (select fid, count(*) n, (select count(*) from facts f where f.fid = g.fid) m from fam_jobs g group by 1) j on j.fid = k.tfid""")
def r3_role_family_catalog(spark, d):
    t = A.tables(spark, d)
    return roles_report.role_family_catalog(t, roles_report.role_family_summaries(t, active.active_listings(t, AS_OF), AS_OF, limit=None)).select("family_id", "job_count", "listing_count")


_COMPANIES = _FAMILY + """, cj as (select n.id, coalesce(who, 'UNKNOWN') company, j.flabel, j.last_seen_at from named n join fam_jobs j using (id)),
 cl as (select cj.company, a.source, a.last_seen_at from active a join cj on cj.id = a.job_id)
 select company, count(*) job_count, (select count(*) from cl where cl.company = cj.company) listing_count, strftime(greatest(max(last_seen_at), (select max(last_seen_at) from cl where cl.company = cj.company)), '%Y-%m-%d') latest_seen,
 (select string_agg(flabel || ':' || n, '; ' order by n desc, flabel) from (select flabel, count(*) n from cj x where x.company = cj.company group by 1 order by 2 desc, 1 limit 5)) top_families,
 (select string_agg(source || ':' || n, '; ' order by n desc, source) from (select source, count(*) n from cl x where x.company = cj.company group by 1 order by 2 desc, 1 limit 5)) top_sources
 from cj group by 1"""


@query(_COMPANIES)
def r4_top_hiring_companies(spark, d):
    t = A.tables(spark, d)
    out = roles_report.top_hiring_companies(t, active.active_listings(t, AS_OF), AS_OF, limit=None)
    return out.select("company", "job_count", "listing_count", day("latest_seen_at").alias("latest_seen"), F.nullif(roles_report.labels("top_families"), F.lit("")).alias("top_families"), F.nullif(roles_report.labels("top_sources"), F.lit("")).alias("top_sources"))


@query("select title, fid family_id, flabel family_label, count(*) jobs from jobs group by all")
def f22_resolve_family(spark, d):
    return active.job_facts(A.tables(spark, d)).groupBy("title", "family_id", "family_label").agg(F.count("*").alias("jobs"))


# demand

_AS_OF = "timestamp '2001-08-01'"


@query(f"select count(*) active_listings, count(*) filter (first_seen_at >= {_AS_OF} - interval 7 day) new_7_days, count(*) filter (first_seen_at >= {_AS_OF} - interval 30 day) new_30_days, count(distinct company) companies, count(distinct fid) families from facts")
def d1_active_summary(spark, d):
    return demand.active_summary(_facts(spark, d)[1], AS_OF)


@query(f"""select company, count(*) active, count(*) filter (first_seen_at >= {_AS_OF} - interval 7 day) new_7_days, count(*) filter (first_seen_at >= {_AS_OF} - interval 30 day) new_30_days, count(distinct flabel) families,
  round(count(*) filter (paid) / count(*), 4) disclosure_rate, (select count(*) from every e where e.company = f.company and first_seen_at >= {_AS_OF} - interval 14 day and first_seen_at < {_AS_OF} - interval 7 day) previous_new,
  count(*) filter (first_seen_at >= {_AS_OF} - interval 7 day) - (select count(*) from every e where e.company = f.company and first_seen_at >= {_AS_OF} - interval 14 day and first_seen_at < {_AS_OF} - interval 7 day) as delta,
  (select string_agg(flabel || ':' || n, '; ' order by n desc, flabel) from (select flabel, count(*) n from facts x where x.company = f.company group by 1 order by 2 desc, 1 limit 5)) top_families from facts f group by 1""")
def d2_company_signals(spark, d):
    t, facts = _facts(spark, d)
    return demand.company_signals(t, facts, AS_OF, None).withColumns({"top_families": roles_report.labels("top_families"), **r4("disclosure_rate")})


@query("select company, fid family_id, flabel family_label, count(*) active from facts group by 1, 2, 3")
def d3_company_role_matrix(spark, d):
    return demand.company_role_matrix(_facts(spark, d)[1], None)


@query(f"select company, count(*) new_listings from every where first_seen_at >= {_AS_OF} - interval 7 day group by 1")
def d4_new_listings(spark, d):
    return demand.new_listings(A.tables(spark, d), AS_OF, 7, None)


@query("select company, count(distinct fid) families, count(*) active from facts group by 1")
def d5_hiring_breadth(spark, d):
    return demand.hiring_breadth(_facts(spark, d)[1], None)


# trends: 26 weeks, the last one starts on Monday 2001-07-30

_WEEKS = """, spine as (select cast(unnest(generate_series(date '2001-07-30' - 175, date '2001-07-30', interval 7 day)) as date) as week),
 wk as (select distinct cast(date_trunc('week', ts) as date) as week, lid from obs where act and ts >= timestamp '2001-07-30' - interval 175 day and ts < timestamp '2001-08-06'),
 wj as (select distinct week, job_id from wk join listings l on l.id = lid),
 sd as (select skill, week, count(distinct wj.job_id) n from wj join js using (job_id) group by 1, 2),
 grid as (select skill, week, coalesce(n, 0) job_count from (select distinct skill from skills) cross join spine left join sd using (skill, week)),
 lagged as (select *, lag(job_count) over (partition by skill order by week) prev from grid)
"""


@query(_WEEKS + "select strftime(week, '%Y-%m-%d') as week, job_count, prev as previous, job_count - prev as delta, round(case when prev <> 0 then (job_count - prev) / prev end, 6) delta_percent from lagged where skill = 'skill_7'")
def t1_skill_demand(spark, d):
    return trends.skill_demand(A.tables(spark, d), " Skill_7", AS_OF, WEEKS).select(day("week").alias("week"), "job_count", "previous", "delta", F.round("delta_percent", 6).alias("delta_percent"))


@query(_WEEKS + "select skill, strftime(week, '%Y-%m-%d') as week, job_count, prev as previous, job_count - prev as delta, round(case when prev <> 0 then (job_count - prev) / prev end, 6) delta_percent from lagged")
def t7_skill_demand_all(spark, d):
    return trends.skill_demand_all(A.tables(spark, d), AS_OF, WEEKS).select("skill", day("week").alias("week"), "job_count", "previous", "delta", F.round("delta_percent", 6).alias("delta_percent"))


@query(_WEEKS + """, one as (select cast(date_trunc('week', ts) as date) as week, e.job_id, annual, row_number() over (partition by date_trunc('week', ts), e.job_id order by ts desc, p desc, s desc, e.pe desc) r
   from (select lid, ts, p, s, e pe from obs where act and ts >= timestamp '2001-07-30' - interval 175 day and ts < timestamp '2001-08-06') o join (select id, job_id, annual from every where annual is not null) e on e.id = o.lid cross join (select 1) z)
 select strftime(week, '%Y-%m-%d') as week, count(job_id) job_count, round(avg(annual), 4) average_annualized from spine left join (select * from one where r = 1) using (week) group by 1""".replace("e.pe desc", "o.pe desc"))
def t2_salary_trend(spark, d):
    return trends.salary_trend(A.tables(spark, d), AS_OF, WEEKS).select(day("week").alias("week"), "job_count", F.round("average_annualized", 4).alias("average_annualized"))


@query(_WEEKS + """select strftime(week, '%Y-%m-%d') as week, (select count(*) from jobs where cast(date_trunc('week', first_seen_at) as date) = week) new_jobs, (select count(*) from jobs where cast(date_trunc('week', closed_at) as date) = week) closed_jobs from spine""")
def t3_posting_velocity(spark, d):
    return trends.posting_velocity(A.tables(spark, d), AS_OF, WEEKS).withColumn("week", day("week"))


_VELOCITY = _WEEKS + ", v as (select week, company_id, coalesce(c.name, 'UNKNOWN') company, count(*) new_jobs from jobs join spine on week = cast(date_trunc('week', first_seen_at) as date) left join companies c on c.id = company_id group by 1, 2, 3) "


@query(_VELOCITY + "select strftime(week, '%Y-%m-%d') as week, company_id, company, new_jobs from v")
def t4_company_velocity(spark, d):
    return trends.company_velocity(A.tables(spark, d), AS_OF, WEEKS).withColumn("week", day("week"))


@query("select count(*) closed_count, quantile_cont(epoch(closed_at - first_seen_at) / 86400, 0.5) median_days, quantile_cont(epoch(closed_at - first_seen_at) / 86400, 0.75) p75_days from jobs where closed_at is not null")
def t5_time_to_close(spark, d):
    return trends.time_to_close(A.tables(spark, d))


@query(_VELOCITY + "select company, cast(sum(new_jobs) as bigint) total, string_agg(strftime(week, '%Y-%m-%d') || ':' || new_jobs, '; ' order by week) as weeks from v group by 1")
def t6_company_velocity_totals(spark, d):
    out = trends.company_velocity_totals(trends.company_velocity(A.tables(spark, d), AS_OF, WEEKS))
    return out.withColumn("weeks", F.array_join(F.transform("weeks", lambda w: F.concat_ws(":", F.date_format(w["week"], "yyyy-MM-dd"), w["new_jobs"])), "; "))


# ingestion

@query("select source, source_job_id, max(day) as day from (select ['lever', 'greenhouse', 'adzuna', 'careers_gov', 'jobstreet'][(l_orderkey + l_linenumber) % 5 + 1] as source, cast(l_orderkey * 10 + l_linenumber as varchar) source_job_id, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem) group by 1, 2", model=False)
def i1_dedupe_batch(spark, d):
    raw = A.raw_listings(spark, d).withColumn("batch_pos", F.struct("last_seen_at", "id"))
    return ingest.dedupe_batch(raw).select("source", "source_job_id", day("last_seen_at").alias("day"))


@query("""select lid source_listing_id, coalesce(min(case when act then rn end) - 1, count(*)) misses from (select *, row_number() over (partition by lid order by ts desc, p desc, s desc, e desc) rn from obs) where rn <= 3 group by 1""")
def i8_consecutive_misses(spark, d):
    return ingest.consecutive_misses(A.observations(spark, d))


@query("""select id from open_jobs where id in (select job_id from listings l join (select lid, coalesce(min(case when act then rn end) - 1, count(*)) misses from (select *, row_number() over (partition by lid order by ts desc, p desc, s desc, e desc) rn from obs) where rn <= 3 group by 1) m on m.lid = l.id where misses >= 2)
  and not exists (select 1 from listings l left join (select lid, act from (select *, row_number() over (partition by lid order by ts desc, p desc, s desc, e desc) rn from obs) where rn = 1) z on z.lid = l.id where l.job_id = open_jobs.id and coalesce(z.act, true))""")
def i9_close_jobs(spark, d):
    """Two misses close a job here, as few listings of the driver tables have three observations."""
    t = A.tables(spark, d)
    now = AS_OF + timedelta(days=1, hours=1)
    after = ingest.close_jobs(t.jobs, t.listings, t.observations, t.listings.select(F.col("id").alias("source_listing_id")), now, 2)
    return after.where(F.col("closed_at") == F.lit(now)).select("id")


#: Alias rows of the matching query: id, skill, alias, case-sensitive. Words and pairs that the texts have.
_ALIASES = [(1, 1, "the", False), (2, 1, "of", False), (3, 2, "que", False), (4, 3, "und", False), (5, 4, "of the", False), (6, 5, "C++", False), (7, 6, ".NET", False), (8, 7, "In", True), (9, 8, "stupid", False), (10, 9, "go", False)]
_ALIAS_SQL = "(values (1, 1, '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])'), (2, 1, '(?i)(^|[^A-Za-z0-9])of($|[^A-Za-z0-9])'), (3, 2, '(?i)(^|[^A-Za-z0-9])que($|[^A-Za-z0-9])'), (4, 3, '(?i)(^|[^A-Za-z0-9])und($|[^A-Za-z0-9])'), (5, 4, '(?i)(^|[^A-Za-z0-9])of the($|[^A-Za-z0-9])'), (8, 7, '(^|[^A-Za-z0-9])In($|[^A-Za-z0-9])'), (9, 8, '(?i)(^|[^A-Za-z0-9])stupid($|[^A-Za-z0-9])')) a(alias_id, skill_id, p)"


@query(f"select doc_id job_id, skill_id, min(alias_id) alias_id from documents join {_ALIAS_SQL} on regexp_matches(text, p) group by 1, 2", model=False)
def i10_skill_matches(spark, d):
    texts = A.read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return matching.find_matches(texts, A.aliases(spark, _ALIASES)).select(F.col("key").alias("job_id"), "skill_id", F.col("alias_id").cast("int").alias("alias_id"))


@query("""select job_id, skill_id, max(c) confidence from (select job_id, skill_id, cast(1 as double) c from job_skills union all select job_id, skill_id, 0.5 from job_skills where skill_id % 2 = 0) group by 1, 2""")
def i11_upsert_job_skills(spark, d):
    rows = A.job_skills(spark, d).withColumns({"extraction_method": F.lit("alias:literal"), "confidence": F.lit(1.0), "matched_text": F.lit(None).cast("string")})
    again = rows.where("skill_id % 2 = 0").withColumn("confidence", F.lit(0.5))
    return matching.upsert_job_skills(rows, again).select("job_id", "skill_id", "confidence")


@query("""select l.source, j.rf ingest_query, count(*) missing from listings l join jobs j on j.id = l.job_id where j.rf = 'data_engineer' and l.source in ('adzuna', 'jobstreet') and l.id % 10 not in (1, 2) group by 1, 2""")
def i7_missing_listings(spark, d):
    t = A.tables(spark, d)
    asked = t.jobs.select(F.col("id").alias("job_id"), F.col("role_family_id").alias("ingest_query"))
    known = t.listings.join(asked, "job_id")
    seen = known.where("id % 10 in (1, 2)")
    targets = spark.createDataFrame([("r", s, "data_engineer") for s in ("adzuna", "jobstreet", "lever")], "run_id string, source string, ingest_query string")
    gone = ingest.missing_listings(known, seen, targets, AS_OF).select(F.col("source_listing_id").alias("id"))
    return known.join(gone, "id").groupBy("source", "ingest_query").agg(F.count("*").alias("missing"))


# duplicates

_PAIRS = """, src as (select job_id, list_sort(list(distinct source)) ss from listings group by 1),
 cand as (select a.id x, b.id y, a.content_hash is not null and a.content_hash = b.content_hash hs from open_jobs a join open_jobs b on a.company_id = b.company_id and a.ntitle = b.ntitle and a.id < b.id
   join src sa on sa.job_id = a.id join src sb on sb.job_id = b.id where sa.ss <> sb.ss and (a.location is null or coalesce(a.location = b.location, false) or b.location is null or coalesce(a.location = b.location, false))),
 ev as (select x, y, max(case when a.resp = b.resp and a.req = b.req then (case when sal then 0.9 else 0.88 end) when (a.resp = b.resp or a.req = b.req) and sal then 0.86 end) score from cand join listings a on a.job_id = x join listings b on b.job_id = y and a.source <> b.source
   cross join lateral (select (a.salary_min is not null or a.salary_max is not null) and (b.salary_min is not null or b.salary_max is not null) and a.salary_min is not distinct from b.salary_min and a.salary_max is not distinct from b.salary_max and a.salary_currency = b.salary_currency and (a.salary_interval is null or b.salary_interval is null or lower(a.salary_interval) = lower(b.salary_interval)) sal)
   where not hs group by 1, 2)
"""


@query(_PAIRS + "select x job_id, y candidate_job_id, 'content_hash' match_type, cast(0.95 as double) score from cand where hs union all select x, y, case when score >= 0.88 then 'structured_fields' else 'structured_fields_salary' end, score from ev where score is not null")
def x1_candidate_pairs(spark, d):
    t = A.tables(spark, d)
    return dedupe.candidate_pairs(t.jobs, t.listings).select("job_id", "candidate_job_id", "match_type", "score")


@query("select source, source_job_id, min(s) as first_seen, max(s) as last_seen, count(*) - 1 removed from (select distinct ['lever', 'greenhouse', 'adzuna', 'careers_gov', 'jobstreet'][(l_orderkey + l_linenumber) % 5 + 1] as source, cast(l_orderkey * 10 + l_linenumber as varchar) source_job_id, strftime(l_shipdate, '%Y-%m-%d') s, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem) group by 1, 2", model=False)
def x4_merge_identity(spark, d):
    raw = A.raw_listings(spark, d)
    moves = dedupe.merge_map(raw, dedupe.identity_key())
    none = spark.createDataFrame([], "id string, source_listing_id string")
    kept, _ = dedupe.merge_listings(raw, none, moves)
    removed = moves.groupBy(F.col("keeper_id").alias("id")).agg(F.count("*").alias("removed"))
    return kept.join(removed, "id", "left").select("source", "source_job_id", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), F.coalesce("removed", F.lit(0).cast("long")).alias("removed"))


_FIELD = """, fg as (select source, source_company_name who, (job_id % 20) t, salary_min lo, salary_max hi, salary_currency cur, lower(salary_interval) iv, resp, req, count(*) n from listings where source_company_name is not null group by all having count(*) > 1)"""


@query(_FIELD + " select count(*) field_groups, cast(coalesce(sum(n - 1), 0) as bigint) field_removable, 0 identity_groups, 0 identity_removable from fg")
def x7_duplicate_stats(spark, d):
    rows = A.listings(spark, d)
    return dedupe.duplicate_stats(rows.withColumn("sections", extract_sections("description_text"))).select("field_groups", "field_removable", F.col("identity_groups").cast("int").alias("identity_groups"), F.col("identity_removable").cast("int").alias("identity_removable"))


@query("""select id, strftime(f, '%Y-%m-%d') first_seen, strftime(l, '%Y-%m-%d') last_seen, cast(n as bigint) observations from (
  select id, row_number() over (partition by g order by last_seen_at desc, id desc) r, min(first_seen_at) over (partition by g) f, max(last_seen_at) over (partition by g) l, sum(n) over (partition by g) n from (
    select x.*, coalesce(o.n, 0) n, case when source_company_name is null then id::varchar else concat_ws('|', 'g', source, source_company_name, job_id % 20, coalesce(salary_min::varchar, '-'), coalesce(salary_max::varchar, '-'), salary_currency, coalesce(lower(salary_interval), '-'), resp, req) end g
    from listings x left join (select lid, count(*) n from obs group by 1) o on o.lid = x.id)) where r = 1""")
def x5_merge_fields(spark, d):
    """Every listing that is left after the merge by fields, with its widened times and its observations."""
    t = A.tables(spark, d)
    moves = dedupe.merge_map(t.listings.withColumn("sections", extract_sections("description_text")), dedupe.field_key())
    kept, moved = dedupe.merge_listings(t.listings, t.observations, moves)
    seen = moved.groupBy(F.col("source_listing_id").alias("id")).agg(F.count("*").alias("observations"))
    return kept.join(seen, "id", "left").select("id", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), F.coalesce("observations", F.lit(0).cast("bigint")).alias("observations"))


@query(_PAIRS + "select count(*) pairs, count(*) created, 0 refreshed, count(*) pending from (select x from cand where hs union all select x from ev where score is not null)")
def x8_scan_candidates(spark, d):
    t = A.tables(spark, d)
    none = spark.createDataFrame([], "job_id long, candidate_job_id long, match_type string, score double, reason string, status string, created_at timestamp")
    return dedupe.scan_candidates(t.jobs, t.listings, none, AS_OF)[1].withColumn("refreshed", F.col("refreshed").cast("int"))


# overview and pages

@query("select (select count(*) from open_jobs) open_jobs, (select count(*) from listings) all_listings, (select count(*) from companies) all_companies, (select count(*) from skills) skills, (select count(*) from jobs where id % 3 = 0) pending_duplicates, (select round(count(*) filter (paid) / count(*), 4) from facts) disclosure_rate, (select count(*) from facts) active_listings")
def o1_overview_kpis(spark, d):
    t, facts = _facts(spark, d)
    candidates = t.jobs.select(F.when(F.col("id") % 3 == 0, "pending").otherwise("merged").alias("status"))
    return overview.overview_kpis(t, facts, candidates, AS_OF).select("open_jobs", "all_listings", "all_companies", "skills", "pending_duplicates", F.round("disclosure_rate", 4).alias("disclosure_rate"), "active_listings")


@query("select count(*) filter (salary_min is null and salary_max is null) without_salary, count(*) filter (not exists (select 1 from job_skills s where s.job_id = listings.job_id)) without_skills from listings")
def o2_missing_counts(spark, d):
    return overview.missing_counts(A.tables(spark, d))


@query("select strftime(max(last_seen_at), '%Y-%m-%d') last_seen_at from listings")
def o3_freshness(spark, d):
    return overview.freshness(A.tables(spark, d)).select(day("last_seen_at").alias("last_seen_at"))


_RUNS = "with runs as (select min(event_id) id, event_type as source, date_trunc('day', ts) started_at, count(*) n from events group by 2, 3) "


@query(_RUNS + "select id, source, strftime(started_at, '%Y-%m-%d') started from runs order by started_at desc, id desc limit 20 offset 5", model=False)
def o5_recent_runs(spark, d):
    return overview.recent_runs(A.runs(spark, d), 20, 5).select("id", "source", day("started_at").alias("started"))


@query(_RUNS + "select count(*) runs, count(*) filter (n % 3 = 0) unhealthy, arg_max(id, (started_at, id)) latest_id from runs", model=False)
def o12_run_health(spark, d):
    return overview.run_health(A.runs(spark, d)).select("runs", "unhealthy", F.col("latest.id").alias("latest_id"))


@query("select id, title, coalesce((salary_min + salary_max) / 2, salary_min, salary_max, 0.0) salary_midpoint from every order by 3 desc, id limit 50 offset 10")
def z1_list_jobs(spark, d):
    t = A.tables(spark, d)
    return overview.list_jobs(active.listing_view(t, t.listings), "salary_midpoint", True, 50, 10).select("id", "title", F.coalesce("salary_midpoint", F.lit(0.0)).alias("salary_midpoint"))


@query("""select j.id job_id, j.title, c.name company_name, j.fid family_id, (select string_agg(skill, ',' order by skill) from js where js.job_id = j.id) skills, (select count(*) from listings l where l.job_id = j.id) listings from jobs j left join companies c on c.id = j.company_id""")
def o7_job_documents(spark, d):
    return overview.job_documents(A.tables(spark, d)).select("job_id", "title", "company_name", "family_id", F.array_join("skills", ",").alias("skills"), F.coalesce(F.size("listings"), F.lit(0)).cast("long").alias("listings"))


@query("""select c.id company_id, c.name, count(j.id) job_count, (select string_agg(id, ',' order by id) from (select id from jobs x where x.company_id = c.id order by id limit 50)) jobs from companies c left join jobs j on j.company_id = c.id group by 1, 2""")
def o8_company_documents(spark, d):
    return overview.company_documents(A.tables(spark, d)).select("company_id", "name", "job_count", F.array_join(F.transform("jobs", lambda j: j["id"].cast("string")), ",").alias("jobs"))


# archive

@query("""select (select count(*) from listings where id % 10 <> 1) left_listings, (select count(*) from obs where lid % 10 <> 1) left_observations, (select count(*) from jobs where id not in (select job_id from listings group by 1 having bool_and(id % 10 = 1))) left_jobs,
  (select count(*) from listings) restored_listings, (select count(*) from obs) restored_observations, (select count(*) from jobs) restored_jobs, (select count(*) from job_skills) restored_skills""")
def y1_archive_and_restore(spark, d):
    """Every first listing of a job is archived, then restored: counts after each."""
    t = A.tables(spark, d)
    ids = t.listings.where("id % 10 = 1").select("id")
    none = spark.createDataFrame([], "job_id long, candidate_job_id long, status string")
    gone = archive.archive_listings(t.listings, t.observations, t.jobs, t.job_skills, none, ids, AS_OF)
    back = archive.restore_listings(gone, ids)
    parts = [gone.listings, gone.observations, gone.jobs, back.listings, back.observations, back.jobs, back.job_skills]
    names = ["left_listings", "left_observations", "left_jobs", "restored_listings", "restored_observations", "restored_jobs", "restored_skills"]
    out = parts[0].agg(F.count("*").alias(names[0]))
    for part, name in zip(parts[1:], names[1:], strict=True):
        out = out.crossJoin(part.agg(F.count("*").alias(name)))  # one row each
    return out


@query("select id source_listing_id, title, coalesce(source_company_name, '') company, source from every where id % 10 = 1")
def y4_list_archive(spark, d):
    t = A.tables(spark, d)
    none = spark.createDataFrame([], "job_id long, candidate_job_id long, status string")
    gone = archive.archive_listings(t.listings, t.observations, t.jobs, t.job_skills, none, t.listings.where("id % 10 = 1").select("id"), AS_OF)
    return archive.list_archive(archive.purge_archive(gone.archive, AS_OF)).select("source_listing_id", "title", F.coalesce("company", F.lit("")).alias("company"), "source")


# text, sources, sinks

@query("select id, 'keep system number ' || resp || ' of the platform running.' responsibilities, req || ' years of work with large tables.' required from listings")
def f14_sections(spark, d):
    rows = A.listings(spark, d).select("id", extract_sections("description_text").alias("s"))
    return rows.select("id", F.col("s")["responsibilities"].alias("responsibilities"), F.col("s")["required_competencies_and_certifications"].alias("required"))


@query("select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) normalized, case when text <> '' then sha256(text) end content_hash from documents", model=False)
def f7_normalize_text(spark, d):
    rows = A.read(spark, d, "documents")
    return rows.select("doc_id", text.normalize_text("text").alias("normalized"), text.content_hash("text").alias("content_hash"))


@query()
def f5_html_to_text(spark, d):
    return A.read(spark, d, "pages").select("page_id", html.html_to_text("html").alias("text"))


@query()
def f6_sanitize_text(spark, d):
    return A.read(spark, d, "pages").select("page_id", html.sanitize_text("html").alias("text"))


@query("select 'careers_gov:p' || page_id id, 'Unknown company' company_name, 'Singapore' as location, 'SGD' salary_currency, cast(page_id as double) salary_min from pages", model=False)
def n4_normalize_careers_gov(spark, d):
    pages = A.read(spark, d, "pages")
    body = F.struct(F.concat(F.lit("p"), "page_id").alias("uuid"), F.lit("Data Engineer").alias("title"), F.col("html").alias("description"), F.struct(F.col("page_id").alias("minimum")).alias("salary"))
    rows = normalize.normalize_careers_gov(pages.select(F.to_json(body).alias("posting")))
    return rows.select(F.concat_ws(":", "source", "source_job_id").alias("id"), "company_name", "location", "salary_currency", "salary_min")


@query("select id, title, source, 'keep system number ' || resp || ' of the platform running.' responsibilities from every")
def io5_export_rows(spark, d):
    t = A.tables(spark, d)
    rows = sinks.export_rows(active.listing_view(t, t.listings))
    return rows.select("id", "title", "source", F.get_json_object("sections", "$.responsibilities").alias("responsibilities"))


@query("select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(distinct user_id) jobs from events where event_type <> 'error' group by 1", model=False)
def st1_weekly_exact(spark, d):
    from hirelens.streaming.observations import weekly_exact

    e = A.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("observed_at"), F.col("user_id").alias("job_id"), (F.col("event_type") != "error").alias("is_active"))
    return weekly_exact(e).withColumn("week", day("week"))


@query("select c_custkey % 100 as bucket, count(*) n from customer group by 1", model=False)
def f20_custom_family(spark, d):
    c = A.read(spark, d, "customer").select((F.col("c_custkey") % 100).alias("bucket"), F.concat(F.lit(" AI & Platform #"), (F.col("c_custkey") % 100).cast("string")).alias("name"))
    rows = c.select("bucket", roles.custom_family_id("name").alias("id")).where(roles.custom_family_label("id") == F.concat(F.lit("AI Platform "), "bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


# upserts: the batch is a posting for every listing, under the listing's identity


def _batch(spark, d):
    rows = A.listings(spark, d)
    names = A.companies(spark, d).select(F.col("id").alias("c"), F.col("name").alias("company_name"))
    owners = A.jobs(spark, d).select(F.col("id").alias("job_id"), F.coalesce("company_id", F.lit(1)).alias("c"), F.col("canonical_url").alias("url"))
    out = rows.join(owners.join(names, "c"), "job_id")
    return out.select(
        F.lit("run").alias("run_id"), F.col("id").alias("batch_pos"), "source", "source_job_id", "company_name", F.col("source_title").alias("title"), F.col("url").alias("canonical_url"), "source_url", "location", "workplace_type", "description_text",
        "salary_min", "salary_max", "salary_currency", "salary_interval", "content_hash", "raw_payload", "text_quality", "source_updated_at", F.lit("data").alias("ingest_query"), F.lit(None).cast("string").alias("ingest_role_family_id"), F.lit("Technology").alias("industry"), "job_id",
    )


_BATCH = ", batch as (select l.*, coalesce(j.company_id, 1) cid from listings l join jobs j on j.id = l.job_id)"


@query(_BATCH + " select name, case when id in (select cid from batch) then 'Technology' when id % 3 = 0 then industry end industry from companies where id % 3 = 0 or id in (select cid from batch)")
def i2_upsert_companies(spark, d):
    """A third of the companies is known beforehand."""
    return ingest.upsert_companies(A.companies(spark, d).where("id % 3 = 0"), _batch(spark, d)).select("name", "industry")


@query("select 'https://example.test/jobs/' || id canonical_url, lower(title) normalized_title, strftime(case when id in (select job_id from listings) then timestamp '2001-08-01' else last_seen_at end, '%Y-%m-%d') last_seen, closed_at is null or id in (select job_id from listings) as is_open from jobs where id % 3 = 0 or id in (select job_id from listings)")
def i3_upsert_jobs(spark, d):
    """A third of the jobs is known beforehand; a job of the batch is seen now and open."""
    old = A.jobs(spark, d).where("id % 3 = 0").withColumn("job_key", F.concat(F.lit("url:"), "canonical_url"))
    companies = A.companies(spark, d)
    out = ingest.upsert_jobs(old, _batch(spark, d), companies, AS_OF)
    return out.select("canonical_url", "normalized_title", day("last_seen_at").alias("last_seen"), F.col("closed_at").isNull().alias("is_open"))


@query(_BATCH + " select id, source, strftime(case when id % 10 in (1, 2) then first_seen_at else timestamp '2001-08-01' end, '%Y-%m-%d') first_seen, '2001-08-01' last_seen, salary_min from listings")
def i4_upsert_listings(spark, d):
    """First and second listings of a job are known beforehand."""
    old = A.listings(spark, d).where("id % 10 in (1, 2)").withColumn("ingest_query", F.lit(None).cast("string")).withColumn("ingestion_run_id", F.lit(None).cast("string"))
    out = ingest.upsert_listings(old, _batch(spark, d), AS_OF)
    return out.select(F.col("source_job_id").cast("long").alias("id"), "source", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), "salary_min")


@query("select id, (closed_at is null or id in (select job_id from listings)) as is_open from jobs")
def i5_reopen_jobs(spark, d):
    t = A.tables(spark, d)
    return ingest.reopen_jobs(t.jobs, t.listings, _batch(spark, d)).select("id", F.col("closed_at").isNull().alias("is_open"))


@query(_BATCH + " select source, count(*) observations, count(distinct id) listings from batch group by 1")
def i6_observations(spark, d):
    rows = ingest.observations_of(_batch(spark, d), AS_OF).select("source_listing_id")
    names = A.listings(spark, d).select(F.xxhash64("source", "source_job_id").alias("source_listing_id"), "source")
    return rows.join(names, "source_listing_id").groupBy("source").agg(F.count("*").alias("observations"), F.count_distinct("source_listing_id").alias("listings"))


@query(_BATCH + " select 'run' run_id, 2 targets_seen, 1 targets_failed, 'completed_with_errors' status, 'no answer' error_message, (select count(*) from batch) listings, (select count(distinct job_id) from batch) jobs")
def i16_ingestion_summary(spark, d):
    targets = spark.createDataFrame([("run", "adzuna", "data", None), ("run", "lever", None, "no answer")], "run_id string, source string, ingest_query string, error string")
    none = spark.createDataFrame([], "x int")
    out = ingest.ingestion_summary(targets, _batch(spark, d), none, none)
    return out.select("run_id", F.col("targets_seen").cast("int").alias("targets_seen"), F.col("targets_failed").cast("int").alias("targets_failed"), "status", "error_message", "listings", "jobs")


@query("select lower(n) normalized_name, t source_taxonomy, max(c) category from (select p_type n, 'parts' t, p_brand c from part union all select 'skill_' || (l_partkey % 40), 'local', 'group_' || (l_partkey % 40 % 4) from lineitem) group by 1, 2", model=False)
def i12_upsert_skills(spark, d):
    """Part types as a taxonomy beside the local skills; the greatest brand comes last."""
    records = A.read(spark, d, "part").select(F.col("p_type").alias("skill_name"), F.col("p_brand").alias("category"), F.lit("parts").alias("source_taxonomy"), F.lit(None).cast("string").alias("taxonomy_version"), F.lit(None).cast("timestamp").alias("source_updated_at"), F.struct("p_brand", "p_partkey").alias("pos"))
    old = A.skills(spark, d).withColumns({"taxonomy_version": F.lit(None).cast("string"), "source_updated_at": F.lit(None).cast("timestamp")})
    return matching.upsert_skills(old, records).select("normalized_name", "source_taxonomy", "category")


@query("select lower(p_type) normalized_name, lower(p_brand) normalized_alias, arg_max(p_size % 2 = 0, p_partkey) case_sensitive from part group by 1, 2", model=False)
def i13_upsert_aliases(spark, d):
    """Brands as aliases of part types."""
    p = A.read(spark, d, "part")
    records = p.select(F.col("p_type").alias("skill_name"), F.lit(None).cast("string").alias("category"), F.lit("parts").alias("source_taxonomy"), F.lit(None).cast("string").alias("taxonomy_version"), F.lit(None).cast("timestamp").alias("source_updated_at"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("alias"), F.lit("literal").alias("match_type"), (F.col("p_size") % 2 == 0).alias("case_sensitive"))
    none = spark.createDataFrame([], "id long, name string, normalized_name string, category string, source_taxonomy string, taxonomy_version string, source_updated_at timestamp")
    owned, named, _ = matching.load_taxonomy(none, spark.createDataFrame([], "id long, skill_id long, alias string, normalized_alias string, match_type string, case_sensitive boolean"), records)
    return named.join(owned.select(F.col("id").alias("skill_id"), "normalized_name"), "skill_id").select("normalized_name", "normalized_alias", "case_sensitive")


_FOUND = "select x, y, cast(0.95 as double) score from cand where hs union all select x, y, score from ev where score is not null"


@query(_PAIRS + f"select x job_id, y candidate_job_id, case when x % 2 = 0 then greatest(score, 0.9) else score end score, case when x % 2 = 0 then 'dismissed' else 'pending' end status from ({_FOUND})")
def x2_upsert_candidates(spark, d):
    """Pairs of even first jobs were dismissed before, with a score of 0.9."""
    t = A.tables(spark, d)
    pairs = dedupe.candidate_pairs(t.jobs, t.listings)
    old = pairs.where("job_id % 2 = 0").withColumns({"score": F.lit(0.9), "status": F.lit("dismissed"), "created_at": F.lit(AS_OF)})
    return dedupe.upsert_candidates(old, pairs, AS_OF).select("job_id", "candidate_job_id", "score", "status")


@query(_PAIRS + f", found as ({_FOUND}), m as (select y, min(x) x from found group by 1), r as (select y, x from m union all select r.y, m.x from r join m on m.y = r.x) select y job_id, min(x) merged_into from r group by 1")
def x9_apply_decisions(spark, d):
    """All candidate pairs merged, chains included: where each merged job's listings went."""
    t = A.tables(spark, d)
    candidates = dedupe.upsert_candidates(spark.createDataFrame([], "job_id long, candidate_job_id long, match_type string, score double, reason string, status string, created_at timestamp"), dedupe.candidate_pairs(t.jobs, t.listings), AS_OF)
    decisions = candidates.select("job_id", "candidate_job_id", F.lit("merge").alias("action"), F.lit("me").alias("actor"), F.lit(None).cast("string").alias("reason"), F.lit("pending").alias("expected_status"))
    out = dedupe.apply_decisions(t.jobs, t.listings, t.job_skills.withColumns({"extraction_method": F.lit("alias:literal"), "confidence": F.lit(1.0), "matched_text": F.lit(None).cast("string")}), candidates, decisions, AS_OF)
    moved = out["listings"].select("id", F.col("job_id").alias("merged_into")).join(t.listings.select("id", "job_id"), "id").where("job_id <> merged_into")
    return moved.select("job_id", "merged_into").distinct()


@query(_PAIRS + f""", found as ({_FOUND}), told as (select x, y, (x + y) % 4 as k from found)
 select x job_id, y candidate_job_id, ['merged', 'dismissed', 'kept_separate', 'pending'][k + 1] as status, case when k < 3 then ['merge', 'dismiss', 'keep_separate'][k + 1] end as action, case when k < 3 then 'pending' end previous_status from told""")
def x9_decisions_of_all_kinds(spark, d):
    """Every pair decided in one of four ways, the fourth with a wrong expected status, which is skipped; with the audit row."""
    t = A.tables(spark, d)
    candidates = dedupe.upsert_candidates(spark.createDataFrame([], "job_id long, candidate_job_id long, match_type string, score double, reason string, status string, created_at timestamp"), dedupe.candidate_pairs(t.jobs, t.listings), AS_OF)
    k = (F.col("job_id") + F.col("candidate_job_id")) % 4
    action = F.get(F.array(*[F.lit(x) for x in ("merge", "dismiss", "keep_separate", "dismiss")]), k.cast("int"))
    decisions = candidates.select("job_id", "candidate_job_id", action.alias("action"), F.lit("me").alias("actor"), F.lit("seen").alias("reason"), F.when(k == 3, "merged").otherwise("pending").alias("expected_status"))
    out = dedupe.apply_decisions(t.jobs, t.listings, t.job_skills.withColumns({"extraction_method": F.lit("alias:literal"), "confidence": F.lit(1.0), "matched_text": F.lit(None).cast("string")}), candidates, decisions, AS_OF)
    audit = out["audit"].where((F.col("actor") == "me") & (F.col("reason") == "seen")).select("job_id", "candidate_job_id", "action", "previous_status")
    return out["candidates"].join(audit, ["job_id", "candidate_job_id"], "left").select("job_id", "candidate_job_id", "status", "action", "previous_status")


ORACLE_SQL["x9_apply_decisions"] = ORACLE_SQL["x9_apply_decisions"].replace("with titles", "with recursive titles", 1)


@query(_PAIRS + f"select x job_id, y candidate_job_id from ({_FOUND}) order by 1, 2 limit 20 offset 3")
def x10_list_candidates(spark, d):
    t = A.tables(spark, d)
    pairs = dedupe.candidate_pairs(t.jobs, t.listings).withColumns({"status": F.lit("pending"), "created_at": F.lit(AS_OF)})
    return dedupe.list_candidates(pairs, "pending", 20, 3).select("job_id", "candidate_job_id")


@query(_FIELD + ", kept as (select l.*, row_number() over (partition by source, source_company_name, job_id % 20, salary_min, salary_max, salary_currency, lower(salary_interval), resp, req order by last_seen_at desc, id desc) r from listings l where source_company_name is not null) select id from jobs where closed_at is null and id in (select job_id from kept where r > 1) and not exists (select 1 from listings l where l.job_id = jobs.id and (l.source_company_name is null or l.id in (select id from kept where r = 1)))")
def x6_close_orphans(spark, d):
    """Open jobs that lose all their listings in the merge by fields."""
    t = A.tables(spark, d)
    moves = dedupe.merge_map(t.listings.withColumn("sections", extract_sections("description_text")), dedupe.field_key())
    kept, _ = dedupe.merge_listings(t.listings, t.observations, moves)
    now = AS_OF + timedelta(days=1, hours=1)
    return dedupe.close_orphans(t.jobs, kept, moves, now).where(F.col("closed_at") == F.lit(now)).select("id")


@query("select skill from js join open_jobs j on j.id = job_id where j.fid = 'robotics' group by 1 order by count(distinct job_id) desc, skill limit 1")
def o4_default_trend_skill(spark, d):
    return overview.default_trend_skill(A.tables(spark, d), AS_OF, None, "robotics")


@query("select tfid segment, count(*) as rows, max(cast(case when tfid = 'other' then 0.0 else 0.95 end as double)) confidence from jobs join titles on i = id % 20 group by 1")
def f19_classify_title(spark, d):
    rows = A.jobs(spark, d).select(roles.classify_title("title").alias("f"))
    return rows.groupBy(F.col("f.id").alias("segment")).agg(F.count("*").alias("rows"), F.max("f.confidence").alias("confidence"))


@query("select id, case when salary_max is not null and factor is not null then (salary_min + salary_max) / 2 * factor end annual, coalesce((salary_min + salary_max) / 2, salary_min, salary_max) loose, case lower(salary_interval) when 'yearly' then 'yearly' when 'hour' then 'hourly' else salary_interval end as interval from listings")
def f17_salary_functions(spark, d):
    rows = A.listings(spark, d)
    return rows.select("id", text.annualized_midpoint("salary_min", "salary_max", "salary_interval").alias("annual"), text.loose_midpoint("salary_min", "salary_max").alias("loose"), text.normalize_interval("salary_interval").alias("interval"))
