"""The adapters' model tables as common table expressions of DuckDB SQL."""

from hirelens.functions.roles import FAMILIES, OTHER, OTHER_LABEL
from hirelens.plans.adapters import TITLES

#: The family that each title of the adapters belongs to, set down by hand.
TITLE_FAMILIES = (
    "data_engineer", "data_scientist", "ai_ml_engineer", "robotics", "software_engineer", "product_manager", "other", "business_analyst", "ux_product_design", "quality_engineer",
    "project_program_manager", "cloud_devops_engineer", "cybersecurity", "data_analyst", "other", "ai_ml_engineer", "software_engineer", "other", "data_engineer", "cloud_devops_engineer",
)
_LABELS = {**{k: v[0] for k, v in FAMILIES.items()}, OTHER: OTHER_LABEL}
_TITLES = ", ".join(f"({i}, '{t}', '{f}', '{_LABELS[f]}')" for i, (t, f) in enumerate(zip(TITLES, TITLE_FAMILIES, strict=True)))

MODEL = f"""
with titles as (select * from (values {_TITLES}) t(i, title, tfid, tlabel)),
companies as (select c_custkey id, c_name as name, c_mktsegment industry from customer),
jobs as (
  select o_orderkey id, case when o_orderkey % 50 <> 0 then o_custkey end company_id, title, lower(title) ntitle,
    case when o_orderkey % 7 = 0 then 'data_engineer' when o_orderkey % 11 = 0 then 'custom:ai_platform' end rf,
    case when o_orderkey % 7 = 0 then 'data_engineer' when o_orderkey % 11 = 0 then 'custom:ai_platform' else tfid end fid,
    case when o_orderkey % 7 = 0 then 'Data Engineer' when o_orderkey % 11 = 0 then 'AI Platform' else tlabel end flabel,
    case when o_orderkey % 5 <> 0 then 'City ' || (o_orderkey % 2) end as location,
    case when o_orderkey % 4 <> 0 then 'h' || (o_orderkey % 3) end content_hash,
    cast(o_orderdate as timestamp) first_seen_at, cast(o_orderdate as timestamp) + to_days(cast(o_orderkey % 90 as int)) last_seen_at,
    case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) + to_days(cast(o_orderkey % 60 + 1 as int)) end closed_at
  from orders join titles on i = o_orderkey % 20),
listings as (
  select k * 10 + n id, k job_id, ['lever', 'greenhouse', 'adzuna', 'careers_gov', 'jobstreet'][(k + n) % 5 + 1] as source,
    case when n % 2 = 0 then 'Agency ' || (k % 10) end source_company_name,
    case when (k + n) % 5 in (2, 4) then 'snippet' else 'full_text' end text_quality,
    case when (k + n) % 3 <> 0 then cast(floor(low / 10) as double) end salary_min,
    case when (k + n) % 3 <> 0 and n <> 7 then cast(floor(high / 8) as double) end salary_max,
    case when k % 4 = 0 then 'USD' else 'SGD' end salary_currency,
    [null, 'monthly', 'monthly', 'Yearly', 'hour', null, 'weekly', 'weekly'][n + 1] salary_interval,
    [null, 12, 12, 1, 2080, null, 52, 52][n + 1] factor, k % 3 resp, (k + n) % 4 + 2 req, first_seen_at, last_seen_at
  from (select l_orderkey k, l_linenumber n, min(l_extendedprice) low, max(l_extendedprice) high, cast(min(l_shipdate) as timestamp) first_seen_at, cast(max(l_shipdate) as timestamp) last_seen_at from lineitem group by 1, 2)),
obs as (select l_orderkey * 10 + l_linenumber lid, cast(l_shipdate as timestamp) ts, l_returnflag <> 'R' act, (l_partkey, l_suppkey, l_extendedprice) oid, l_partkey p, l_suppkey s, l_extendedprice e from lineitem),
skills as (select distinct l_partkey % 40 id, 'skill_' || (l_partkey % 40) skill from lineitem),
job_skills as (select distinct l_orderkey job_id, l_partkey % 40 skill_id from lineitem),
newest as (select lid, max(ts) ts from obs group by 1),
latest as (select lid, bool_or(act) act from obs join newest using (lid, ts) group by 1),
active as (select l.* from listings l join jobs j on j.id = l.job_id and j.closed_at is null left join latest t on t.lid = l.id where coalesce(t.act, true)),
every as (
  select l.*, j.title, j.ntitle, j.fid, j.flabel, coalesce(c.name, l.source_company_name, 'UNKNOWN') company, c.name cname,
    (salary_min + salary_max) / 2 midpoint, (salary_min + salary_max) / 2 * factor annual, salary_min is not null or salary_max is not null paid
  from listings l join jobs j on j.id = l.job_id left join companies c on c.id = j.company_id),
facts as (select e.* from every e join active a on a.id = e.id),
open_jobs as (select * from jobs where closed_at is null),
js as (select job_id, skill from job_skills join skills on skills.id = skill_id)
"""
