"""Registered queries that keep results up to date run by run, or read them from what is stored: streams, keyed state, bitmaps, merges, intervals, ranks, pages, postings."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import text
from hirelens.operators import active, bitmaps, duplicate_classes, ingest, intervals, matching, paging, ranks, salary, search
from hirelens.plans import adapters as A
from hirelens.plans import more_queries  # noqa: F401  its SQL is used again
from hirelens.plans.queries import _PAIRS, _WEEKS, AS_OF, ORACLE_SQL, WEEKS, _batch, _facts, day, query
from hirelens.sources.merge import MergedTable
from hirelens.sources.shared import kept, shared_dir
from hirelens.streaming import lifecycle, observations

LANDINGS = 6


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as observations; `landing` is when they come: one in 25 comes two landings after its time, one in 10 once more with the next."""
    e = A.read(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    first = e.agg(F.date_trunc("day", F.min(at))).first()[0]
    slot = F.least(F.datediff(at, F.lit(first)) / 5, F.lit(LANDINGS - 1)).cast("int")
    last = F.lit(LANDINGS - 1)
    times = F.array(F.least(slot + F.when(F.col("event_id") % 25 == 0, 2).otherwise(0), last), F.when(F.col("event_id") % 10 == 0, F.least(slot + 1, last)))
    rows = e.select(F.date_format(at, "yyyy-MM-dd").alias("run_id"), F.lit("lever").alias("source"), F.col("event_id").cast("string").alias("source_job_id"), F.col("user_id").alias("job_id"), at.alias("observed_at"), (F.col("event_type") != "error").alias("is_active"), F.explode(times).alias("landing"))
    return rows.where("landing is not null")


_LANDED = """with e as (select *, least(date_diff('day', (select cast(min(ts) as date) from events), cast(ts as date)) // 5, 5) as slot from events),
 l as (select *, unnest([least(slot + case when event_id % 25 = 0 then 2 else 0 end, 5), case when event_id % 10 = 0 then least(slot + 1, 5) end]) landing from e),
 w as (select landing, max(date_trunc('millisecond', ts)) - interval 7 day as mark from l where landing is not null group by 1),
 taken as (select l.* from l where landing is not null and ts > coalesce((select max(mark) from w where w.landing < l.landing), timestamp '1900-01-01'))
"""


@query(_LANDED + "select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(distinct user_id) jobs from taken where event_type <> 'error' group by 1", model=False)
def st1_stream_weekly(spark, d):
    """Landings that come one by one, each taken in by a stream that restarts from its checkpoint; late and repeated rows among them."""
    rows, base = _events(spark, d), shared_dir(spark)
    for n in range(LANDINGS):
        rows.where(F.col("landing") == n).drop("landing").write.mode("append").parquet(f"{base}/landing")
        observations.follow_weekly(spark, f"{base}/landing", f"{base}/weeks", f"{base}/checkpoint").awaitTermination()
    return observations.weekly_of(spark.read.parquet(f"{base}/weeks")).withColumn("week", day("week"))


def _polls(spark: SparkSession, d: str) -> tuple[DataFrame, list[int], datetime]:
    """Purchases as what daily runs find: (run, source_listing_id, observed_at at the run's day, is_active), the runs, and the first day."""
    e = A.read(spark, d, "events")
    at = F.date_trunc("day", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(at), F.max(at)).first()
    found = e.where("event_type = 'purchase'").select(F.col("user_id").alias("source_listing_id"), at.alias("observed_at"), F.lit(True).alias("is_active")).distinct()
    return found.withColumn("run", F.datediff("observed_at", F.lit(first))), list(range((last - first).days + 1)), first


def _listing_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of all listings, from daily runs that land and are taken in six at a time."""
    (found, runs, first), base = _polls(spark, d), shared_dir(spark)
    found = kept(found)
    for n in range(0, len(runs), 6):
        own = runs[n : n + 6]
        ends = [(None, first + timedelta(days=run, hours=12), False) for run in own]  # a run's end, half an interval after it
        found.where(F.col("run").isin(own)).drop("run").unionByName(spark.createDataFrame(ends, lifecycle.POLL)).write.mode("append").parquet(f"{base}/landing")
        lifecycle.follow(spark, f"{base}/landing", f"{base}/events", f"{base}/checkpoint", timedelta(days=1)).awaitTermination()
    return spark.read.schema(lifecycle.EVENT).parquet(f"{base}/events")


_FOUND = """with f as (select distinct user_id, cast(ts as date) as day from events where event_type = 'purchase'),
 g as (select *, coalesce(lead(day) over (partition by user_id order by day), (select max(cast(ts as date)) from events) + 1) nxt, lead(day) over (partition by user_id order by day) is null latest from f),
 states as (select user_id, cast(max(case when latest then least(nxt - day - 1, 3) end) as int) misses, count(*) filter (where nxt - day > 3) closings from g group by 1)
"""


@query(_FOUND + "select user_id as source_listing_id, misses, closings, misses >= 3 as closed from states", model=False)
def i8_lifecycle_states(spark, d):
    """Misses, closings and state of every listing by keyed state with timers, over all runs; equal to looking back at the whole log."""
    return lifecycle.listing_states(_listing_events(spark, d)).withColumn("misses", F.col("misses").cast("int"))


@query(_FOUND + "select user_id // 3 as job_id from states group by 1 having min(misses) > 0 and max(misses) >= 3", model=False)
def i9_lifecycle_closed_jobs(spark, d):
    """Jobs of three listings each that the runs have closed."""
    states = lifecycle.listing_states(_listing_events(spark, d))
    listings = states.select(F.col("source_listing_id").alias("id"), F.floor(F.col("source_listing_id") / 3).alias("job_id"))
    return lifecycle.closed_jobs(listings, states).select("job_id")


def _runs(observations: DataFrame) -> list[DataFrame]:
    """The observation log as four runs, dealt by listing and time."""
    part: Column = F.pmod(F.xxhash64("source_listing_id", "observed_at"), F.lit(4))
    return [observations.where(part == n) for n in range(4)]


@query(_WEEKS + "select skill, strftime(week, '%Y-%m-%d') as week, job_count, prev as previous, job_count - prev as delta, round(case when prev <> 0 then (job_count - prev) / prev end, 6) delta_percent from lagged")
def t7_demand_from_bitmaps(spark, d):
    """Weekly demand of every skill from bitmaps that four runs have merged, the third one twice."""
    t = A.tables(spark, d)
    numbers = weekly = None
    runs = _runs(t.observations)
    for own in (*runs, runs[2]):
        jobs = own.select(F.col("source_listing_id").alias("id")).join(t.listings.select("id", "job_id"), "id")
        known = numbers if numbers is not None else spark.createDataFrame([], "job_id long, number long")
        numbers = bitmaps.number_jobs(known, jobs)
        new = bitmaps.weekly_active(t, own, numbers)
        weekly = kept(new if weekly is None else bitmaps.merged(weekly, new, ["week"]))
    out = bitmaps.skill_demand(weekly, bitmaps.skill_bitmaps(t, numbers), t.skills.select(F.col("name").alias("skill")), AS_OF, WEEKS)
    return out.select("skill", day("week").alias("week"), "job_count", "previous", "delta", F.round("delta_percent", 6).alias("delta_percent"))


# merges into stored tables: the batch comes twice, the second time nothing is written


def _merged(spark: SparkSession, old: DataFrame, key: list[str], new: DataFrame, upsert) -> DataFrame:
    table = MergedTable(spark, f"merged_{uuid.uuid4().hex}", key, parts=16, buckets=4)
    table.create(old)
    table.merge(new, upsert)
    if table.merge(new, upsert):
        raise ValueError("a repeated merge wrote something")
    return table.read()


@query(ORACLE_SQL["i2_upsert_companies"], model=False)
def i2_merge_companies(spark, d):
    """Companies as a stored table, merged by their normalised names."""
    old = A.companies(spark, d).where("id % 3 = 0")
    batch = _batch(spark, d).withColumn("normalized_name", text.normalize_text("company_name"))
    return _merged(spark, old, ["normalized_name"], batch, lambda o, n: ingest.upsert_companies(o, n)).select("name", "industry")


@query(ORACLE_SQL["i3_upsert_jobs"], model=False)
def i3_merge_jobs(spark, d):
    """Jobs as a stored table, merged by their keys."""
    old = A.jobs(spark, d).where("id % 3 = 0").withColumn("job_key", F.concat(F.lit("url:"), "canonical_url"))
    batch = _batch(spark, d).withColumn("job_key", ingest.job_key(F.col("canonical_url")))
    out = _merged(spark, old, ["job_key"], batch, lambda o, n: ingest.upsert_jobs(o, n, A.companies(spark, d), AS_OF))
    return out.select("canonical_url", "normalized_title", day("last_seen_at").alias("last_seen"), F.col("closed_at").isNull().alias("is_open"))


@query(ORACLE_SQL["i4_upsert_listings"], model=False)
def i4_merge_listings(spark, d):
    """Listings as a stored table, merged by their identity."""
    old = A.listings(spark, d).where("id % 10 in (1, 2)").withColumn("ingest_query", F.lit(None).cast("string")).withColumn("ingestion_run_id", F.lit(None).cast("string"))
    out = _merged(spark, old, ingest.IDENTITY, _batch(spark, d), lambda o, n: ingest.upsert_listings(o, n, AS_OF))
    return out.select(F.col("source_job_id").cast("long").alias("id"), "source", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), "salary_min")


@query(ORACLE_SQL["i12_upsert_skills"], model=False)
def i12_merge_skills(spark, d):
    """Skills as a stored table, merged by normalised name and taxonomy."""
    records = A.read(spark, d, "part").select(F.col("p_type").alias("skill_name"), F.col("p_brand").alias("category"), F.lit("parts").alias("source_taxonomy"), F.lit(None).cast("string").alias("taxonomy_version"), F.lit(None).cast("timestamp").alias("source_updated_at"), F.struct("p_brand", "p_partkey").alias("pos"))
    old = A.skills(spark, d).withColumns({"taxonomy_version": F.lit(None).cast("string"), "source_updated_at": F.lit(None).cast("timestamp")})
    out = _merged(spark, old, ["normalized_name", "source_taxonomy"], records.withColumn("normalized_name", text.normalize_text("skill_name")), matching.upsert_skills)
    return out.select("normalized_name", "source_taxonomy", "category")


# active sets of the past, percentiles by rank, pages by key, search by postings

_TIMES = [AS_OF - timedelta(days=500 * k) for k in range(6)]
_AT = "(values " + ", ".join(f"(timestamp '{t:%Y-%m-%d}')" for t in _TIMES) + ") x(t)"


@query(f""", seen_at as (select t, lid, bool_or(act) act from (select t, lid, act, rank() over (partition by t, lid order by ts desc) r from obs join {_AT} on ts <= t) where r = 1 group by 1, 2)
 select strftime(t, '%Y-%m-%d') as as_of, l.id, l.job_id, l.source from {_AT} cross join listings l join jobs j on j.id = l.job_id and (j.closed_at is null or j.closed_at > t)
 left join seen_at on seen_at.lid = l.id and seen_at.t = x.t where coalesce(act, true)""".replace("select strftime(t,", "select strftime(x.t,").replace("j.closed_at > t)", "j.closed_at > x.t)"))
def a2_active_at_times(spark, d):
    """Active listings at six times in one pass over validity intervals, which two runs of the log have built."""
    t = A.tables(spark, d)
    log, middle = t.observations.select("source_listing_id", "observed_at", "is_active"), _TIMES[3]
    spans = intervals.extended(kept(intervals.validity(log.where(F.col("observed_at") < F.lit(middle)))), log.where(F.col("observed_at") >= F.lit(middle)))
    return intervals.active_at(t, kept(spans), _TIMES).select(day("as_of").alias("as_of"), "id", "job_id", "source")


@query(ORACLE_SQL["f29_percentiles"], model=False)
def f29_percentiles_by_rank(spark, d):
    """Percentiles of every price by ranks in ranges."""
    rows = A.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = ranks.exact_percentiles(rows, ["flag"], "l_extendedprice", {"p25": 0.25, "median": 0.5, "p90": 0.9})
    return out.select("flag", *[F.round(c, 4).alias(c) for c in ("p25", "median", "p90")])


def _ranked_segments(facts: DataFrame, segments: Column) -> DataFrame:
    return salary.salary_by_ranks(facts, segments).withColumns({c: F.round(c, 4) for c in ("average", "p25", "median", "p75")})


@query(ORACLE_SQL["p4_salary_by_source"], model=False)
def p4_salary_by_source_ranks(spark, d):
    return _ranked_segments(_facts(spark, d)[1], F.array("source"))


@query(ORACLE_SQL["p5_salary_by_company"], model=False)
def p5_salary_by_company_ranks(spark, d):
    return _ranked_segments(_facts(spark, d)[1], F.array("company"))


_PAGED = "select id, title, coalesce((salary_min + salary_max) / 2, salary_min, salary_max) salary_midpoint, row_number() over (order by coalesce((salary_min + salary_max) / 2, salary_min, salary_max) desc nulls last, id) place from every"


@query(_PAGED)
def z1_pages_to_the_end(spark, d):
    """All listings by salary, nulls last, as pages that each go on after the last row of the one before."""
    t = A.tables(spark, d)
    rows = kept(active.listing_view(t, t.listings).select("id", "title", "salary_midpoint"))
    order, last, out = [("salary_midpoint", True), ("id", False)], None, []
    size = -(-rows.count() // 5)
    for n in range(5):
        shown = kept(paging.placed(rows, order, size, last))
        last = paging.cursor(shown, order)
        out.append(shown.withColumn("place", F.col("place") + n * size))
        if last is None:
            break
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


@query(ORACLE_SQL["a3_search_listings"], model=False)
def a3_search_by_postings(spark, d):
    """The searches of a3 from a stored index of character runs."""
    t = A.tables(spark, d)
    view = kept(active.listing_view(t, t.listings).select("id", "source", "role_family", *search.FIELDS))  # what is searched and shown
    index = search.build(view)
    rows = lambda n, *how: index.search(view, *how).select("id", F.coalesce("company", F.lit("UNKNOWN")).alias("company"), "role_family", F.lit(n).alias("hit"))
    return rows(1, "lever", None, " NUMBER  2 of ").unionByName(rows(2, None, None, "Data Engineer"))


# duplicates by profiles


@query(ORACLE_SQL["x1_candidate_pairs"], model=False)
def x1_pairs_of_profiles(spark, d):
    """All candidate pairs, listed from the links between profiles."""
    t = A.tables(spark, d)
    members = duplicate_classes.profiles(t.jobs, t.listings)
    return duplicate_classes.expanded(members, duplicate_classes.profile_links(t.jobs, t.listings, members)).select("job_id", "candidate_job_id", "match_type", "score")


@query(_PAIRS + """, found as (select x, y from cand where hs union all select x, y from ev where score is not null), both_ways as (select x, y from found union all select y, x from found),
 walk as (select x, x as y from both_ways union select w.x, b.y from walk w join both_ways b on b.x = w.y)
 select x as job_id, min(y) as class_id, (select count(*) from both_ways b where b.x = walk.x) as links from walk group by 1""")
def x1_duplicate_classes(spark, d):
    """Class and number of partners of every job that has one."""
    t = A.tables(spark, d)
    members = duplicate_classes.profiles(t.jobs, t.listings)
    return duplicate_classes.duplicate_classes(members, duplicate_classes.profile_links(t.jobs, t.listings, members))


ORACLE_SQL["x1_duplicate_classes"] = ORACLE_SQL["x1_duplicate_classes"].replace("with titles", "with recursive titles", 1)
