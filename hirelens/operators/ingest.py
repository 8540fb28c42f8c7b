"""Ingestion: batch dedup, upserts, observations and the lifecycle of postings.

A batch is a frame of normalised postings (schemas.POSTING) with run_id, batch_pos (place in
fetch order), ingest_query and ingest_role_family_id. Surrogate ids are hashes of natural
keys, so a run that is repeated gives the same ids.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.text import normalize_text
from hirelens.operators import duplicate_classes, matching
from hirelens.schemas import Tables
from hirelens.sources.shared import kept

QUERY_SOURCES = ("adzuna", "careers_gov", "jobstreet")
MISSES_TO_CLOSE = 3
IDENTITY = ["source", "source_job_id"]


def last_by(c: str, *order: str) -> Column:
    """The value of the last row that has one."""
    has = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return F.max_by(c, F.struct(has.alias("has"), *order))


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """One row for each (source, source_job_id): the last in fetch order."""
    order = Window.partitionBy(*IDENTITY).orderBy(F.desc("batch_pos"))
    return batch.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def company_id(name: Column) -> Column:
    return F.xxhash64(normalize_text(name))


def upsert_companies(old: DataFrame, batch: DataFrame) -> DataFrame:
    """By normalised name: the first name stays, a new known industry replaces."""
    rows = batch.withColumn("normalized_name", normalize_text("company_name"))
    industry = F.col("industry") if "industry" in batch.columns else F.lit(None).cast("string")
    new = rows.withColumn("new_industry", industry).groupBy("normalized_name").agg(F.min_by("company_name", "batch_pos").alias("new_name"), last_by("new_industry", "batch_pos").alias("new_industry"))
    joined = old.select("id", "name", "normalized_name", "industry").join(new, "normalized_name", "full")
    return joined.select(F.coalesce("id", F.xxhash64("normalized_name")).alias("id"), F.coalesce("name", "new_name").alias("name"), "normalized_name", F.coalesce("new_industry", "industry").alias("industry"))


def job_key(url: Column) -> Column:
    """Postings of one URL are one job; without a URL the listing's identity is the key."""
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url)).otherwise(F.concat_ws(":", F.lit("listing"), "source", "source_job_id"))


def upsert_jobs(old: DataFrame, batch: DataFrame, companies: DataFrame, now: datetime) -> DataFrame:
    """old has job_key. On a match text, hash, family and payload are replaced where the new ones are known; titles stay."""
    keyed = batch.withColumn("job_key", job_key(F.col("canonical_url"))).withColumn("normalized_name", normalize_text("company_name"))
    first = lambda c: F.min_by(c, "batch_pos").alias(f"n_{c}")
    last = lambda c: last_by(c, "batch_pos").alias(f"n_{c}")
    new = keyed.groupBy("job_key").agg(first("title"), first("normalized_name"), first("canonical_url"), first("location"), first("workplace_type"), last("description_text"), last("content_hash"), last("ingest_role_family_id"), last("raw_payload"))
    ids = companies.groupBy(F.col("normalized_name").alias("n_normalized_name")).agg(F.min("id").alias("n_company_id"))  # one a name, or its jobs would come twice
    joined = old.join(new.join(ids, "n_normalized_name", "left"), "job_key", "full")
    seen = F.col("n_title").isNotNull()
    newer = lambda c, n=None: F.coalesce(f"n_{n or c}", c).alias(c)
    older = lambda c: F.coalesce(c, f"n_{c}").alias(c)
    at = F.lit(now)
    return joined.select(
        F.coalesce("id", F.xxhash64("job_key")).alias("id"), "job_key", older("company_id"), older("title"), F.coalesce("normalized_title", normalize_text("n_title")).alias("normalized_title"),
        newer("role_family_id", "ingest_role_family_id"), older("canonical_url"), older("location"), older("workplace_type"), newer("description_text"), newer("content_hash"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(seen, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(~seen, F.col("closed_at")).alias("closed_at"), newer("raw_payload"),
    )


def upsert_listings(old: DataFrame, batch: DataFrame, now: datetime) -> DataFrame:
    """By identity: all fields of a new row hold, nulls too, but for the first time seen. batch is deduplicated."""
    new = batch.select(
        *IDENTITY, F.col("run_id").alias("ingestion_run_id"), F.xxhash64(job_key(F.col("canonical_url"))).alias("job_id"), "canonical_url", "source_url", F.col("company_name").alias("source_company_name"), F.col("title").alias("source_title"),
        "location", "workplace_type", "description_text", F.coalesce("text_quality", F.lit("full_text")).alias("text_quality"), "salary_min", "salary_max", "salary_currency", "salary_interval", "content_hash", "raw_payload", "source_updated_at", "ingest_query",
    )
    at, joined = F.lit(now), old.alias("o").join(new.alias("n"), IDENTITY, "full")
    seen = F.col("n.text_quality").isNotNull()
    pick = lambda c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    plain = [c for c in new.columns if c not in (*IDENTITY, "job_id")]
    return joined.select(
        F.coalesce("o.id", F.xxhash64(*IDENTITY)).alias("id"), *IDENTITY, F.coalesce("n.job_id", "o.job_id").alias("job_id"), *[pick(c) for c in plain],
        F.coalesce("o.first_seen_at", at).alias("first_seen_at"), F.when(seen, at).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
    )


def reopen_jobs(jobs: DataFrame, listings: DataFrame, batch: DataFrame) -> DataFrame:
    """Jobs of listings that are seen again lose their closing time."""
    seen = listings.join(batch.select(*IDENTITY), IDENTITY, "left_semi").select(F.col("job_id").alias("seen_job")).distinct()
    joined = jobs.join(seen, jobs["id"] == seen["seen_job"], "left")
    return joined.withColumn("closed_at", F.when(F.col("seen_job").isNull(), F.col("closed_at"))).drop("seen_job")


def observations_of(batch: DataFrame, now: datetime) -> DataFrame:
    """One active observation for each posting of a deduplicated batch."""
    listing = F.xxhash64(*IDENTITY)
    return batch.select(F.xxhash64(listing, "run_id", F.lit(True)).alias("id"), listing.alias("source_listing_id"), F.col("run_id").alias("ingestion_run_id"), F.lit(now).alias("observed_at"), F.lit(True).alias("is_active"), "source_updated_at", "content_hash", "raw_payload")


def missing_listings(listings: DataFrame, batch: DataFrame, targets: DataFrame, now: datetime) -> DataFrame:
    """Inactive observations for listings that a successful query of the run should have found.

    targets: run_id, source, ingest_query, of queries that were fetched without error.
    """
    asked = targets.where(F.col("source").isin(*QUERY_SOURCES) & F.col("ingest_query").isNotNull()).select("run_id", F.col("source").alias("s"), F.col("ingest_query").alias("q")).distinct()
    known = listings.join(asked, (F.col("source") == F.col("s")) & (F.col("ingest_query") == F.col("q")))
    gone = known.join(batch.select(*IDENTITY), IDENTITY, "left_anti")
    none = F.lit(None).cast("string")
    return gone.select(F.xxhash64("id", "run_id", F.lit(False)).alias("id"), F.col("id").alias("source_listing_id"), F.col("run_id").alias("ingestion_run_id"), F.lit(now).alias("observed_at"), F.lit(False).alias("is_active"), F.lit(None).cast("timestamp").alias("source_updated_at"), none.alias("content_hash"), none.alias("raw_payload"))


def consecutive_misses(observations: DataFrame, most: int = MISSES_TO_CLOSE) -> DataFrame:
    """(source_listing_id, misses): inactive observations before the first active one among the newest `most`."""
    order = Window.partitionBy("source_listing_id").orderBy(F.desc("observed_at"), F.desc("id"))
    newest = observations.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    first_active = F.min(F.when(F.col("is_active"), F.col("n")))
    return newest.groupBy("source_listing_id").agg(F.coalesce(first_active - 1, F.count("*")).cast("long").alias("misses"))


def close_jobs(jobs: DataFrame, listings: DataFrame, observations: DataFrame, missed: DataFrame, now: datetime, most: int = MISSES_TO_CLOSE) -> DataFrame:
    """Open jobs with a listing of `missed` (source_listing_id) that has missed enough, and no listing whose latest observation is active or missing."""
    latest = observations.groupBy("source_listing_id").agg(F.max_by("is_active", F.struct("observed_at", "id")).alias("latest"))
    owned = listings.where("job_id is not null").select("job_id", F.col("id").alias("source_listing_id"))
    idle = owned.join(latest, "source_listing_id", "left").groupBy("job_id").agg(F.bool_and(~F.coalesce("latest", F.lit(True))).alias("idle")).where("idle")
    enough = consecutive_misses(observations.join(missed.select("source_listing_id").distinct(), "source_listing_id", "left_semi"), most).where(F.col("misses") >= most)
    due = owned.join(enough, "source_listing_id").select("job_id").distinct().join(idle, "job_id").select(F.col("job_id").alias("due"))
    joined = jobs.join(due, jobs["id"] == due["due"], "left")
    return joined.withColumn("closed_at", F.when(F.col("closed_at").isNull() & F.col("due").isNotNull(), F.lit(now)).otherwise(F.col("closed_at"))).drop("due")


def ingestion_summary(targets: DataFrame, batch: DataFrame, job_skills: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per run: targets seen, ingested and failed, jobs, listings, observations; status and errors. targets: run_id, source, ingest_query, error."""
    own = targets.groupBy("run_id").agg(F.count("*").alias("targets_seen"), F.count_if(F.col("error").isNull()).alias("targets_ingested"), F.count_if(F.col("error").isNotNull()).alias("targets_failed"), F.concat_ws("\n", F.sort_array(F.collect_list("error"))).alias("error_message"))
    made = batch.groupBy("run_id").agg(F.count("*").alias("listings"), F.count_distinct(job_key(F.col("canonical_url"))).alias("jobs"), F.count("*").alias("observations"))
    status = F.when(F.col("targets_failed") > 0, "completed_with_errors").otherwise("completed")
    counts = job_skills.agg(F.count("*").alias("job_skills")).crossJoin(candidates.agg(F.count("*").alias("candidates")))  # one row
    return own.join(made, "run_id", "left").fillna(0, ["listings", "jobs", "observations"]).withColumn("status", status).crossJoin(counts)


def ingest(t: Tables, aliases: DataFrame, candidates: DataFrame, batch: DataFrame, targets: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """One run over all its targets: every table after it. t.jobs has job_key, t.listings has ingest_query.

    What is used more than once (the batch, listings, jobs, skills, candidates) is written to the shared folder, so nothing is left in the cache.
    """
    rows = kept(dedupe_batch(batch))
    companies = upsert_companies(t.companies, rows)
    jobs = upsert_jobs(t.jobs, rows, companies, now)
    listings = kept(upsert_listings(t.listings, rows, now))
    missed = missing_listings(listings, rows, targets, now)
    observations = t.observations.unionByName(observations_of(rows, now)).unionByName(missed)
    jobs = kept(close_jobs(reopen_jobs(jobs, listings, rows), listings, observations, missed, now))
    touched = rows.select(F.xxhash64(job_key(F.col("canonical_url"))).alias("id"), "text_quality").join(jobs.select("id", "description_text"), "id").withColumnRenamed("id", "job_id")
    job_skills = kept(matching.upsert_job_skills(t.job_skills, matching.extract_job_skills(touched, aliases)))
    buckets = jobs.join(touched.select(F.col("job_id").alias("id")), "id", "left_semi").select("company_id", "normalized_title").distinct()
    pairs = duplicate_classes.coded_pairs(jobs.join(buckets, ["company_id", "normalized_title"], "left_semi"), listings)
    new_candidates = kept(duplicate_classes.upsert_coded(candidates, pairs, now))
    summary = ingestion_summary(targets, rows, job_skills, new_candidates)
    return {"companies": companies, "jobs": jobs, "listings": listings, "observations": observations, "job_skills": job_skills, "candidates": new_candidates, "summary": summary}
