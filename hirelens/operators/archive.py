"""Archive of deleted listings: nested records that restore what was deleted, ids included."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT_DAYS = 2


@dataclass
class Archived:
    """Tables after a deletion, and the archive rows of it."""

    listings: DataFrame
    observations: DataFrame
    jobs: DataFrame
    job_skills: DataFrame
    candidates: DataFrame
    archive: DataFrame


def _rows(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias(f"{name}_key")).agg(F.collect_list(F.struct(*df.columns)).alias(name))


def archive_listings(listings: DataFrame, observations: DataFrame, jobs: DataFrame, job_skills: DataFrame, candidates: DataFrame, ids: DataFrame, now: datetime) -> Archived:
    """ids: id of the listings that go. A job goes with its last listing, and with it its skills and candidates."""
    going = listings.join(ids.select("id").distinct(), "id", "left_semi")
    staying = listings.join(ids.select("id").distinct(), "id", "left_anti")
    lost = going.where("job_id is not null").select("job_id").distinct().join(staying.select("job_id").distinct(), "job_id", "left_anti")
    # the job's rows go with the listing of it that has the greatest id
    carrier = going.join(lost, "job_id", "left_semi").groupBy("job_id").agg(F.max("id").alias("carrier"))
    pairs = candidates.select(F.explode(F.array_distinct(F.array("job_id", "candidate_job_id"))).alias("of"), *candidates.columns).join(lost, F.col("of") == lost["job_id"], "left_semi")
    pairs = pairs.groupBy(*candidates.columns).agg(F.min("of").alias("of"))
    nested = pairs.groupBy("of").agg(F.collect_list(F.struct(*candidates.columns)).alias("candidates"))
    old_jobs = jobs.join(lost, jobs["id"] == lost["job_id"], "left_semi").select(F.struct(*jobs.columns).alias("job"), F.col("id").alias("job_key"))
    skills = _rows(job_skills.join(lost, "job_id", "left_semi").select(*job_skills.columns), "job_id", "skills")
    own = carrier.join(old_jobs, F.col("job_id") == F.col("job_key")).join(skills, F.col("job_id") == F.col("skills_key"), "left").join(nested, F.col("job_id") == F.col("of"), "left").select("carrier", "job", "skills", "candidates")
    seen = _rows(observations, "source_listing_id", "observations")
    base = going.select(F.col("id").alias("source_listing_id"), F.struct(*listings.columns).alias("listing"))
    archive = base.join(seen, F.col("source_listing_id") == F.col("observations_key"), "left").join(own, F.col("source_listing_id") == F.col("carrier"), "left").select("source_listing_id", F.lit(now).alias("deleted_at"), "listing", "observations", "job", "skills", "candidates")
    gone = ids.select(F.col("id").alias("source_listing_id")).distinct()
    touched = lost.select(F.col("job_id").alias("lost"))
    left = candidates.join(touched, F.col("job_id") == F.col("lost"), "left_anti").join(touched, F.col("candidate_job_id") == F.col("lost"), "left_anti")
    return Archived(staying, observations.join(gone, "source_listing_id", "left_anti").select(*observations.columns), jobs.join(lost, jobs["id"] == lost["job_id"], "left_anti"), job_skills.join(lost, "job_id", "left_anti").select(*job_skills.columns), left, archive)


def restore_listings(after: Archived, ids: DataFrame) -> Archived:
    """The inverse, for the archive rows of these listing ids."""
    back = after.archive.join(ids.select(F.col("id").alias("source_listing_id")).distinct(), "source_listing_id", "left_semi")
    rows = lambda c: back.where(F.col(c).isNotNull()).select(F.inline(c))
    one = lambda c: back.where(F.col(c).isNotNull()).select(f"{c}.*")
    rest = after.archive.join(ids.select(F.col("id").alias("source_listing_id")).distinct(), "source_listing_id", "left_anti")
    return Archived(
        after.listings.unionByName(one("listing")), after.observations.unionByName(rows("observations")), after.jobs.unionByName(one("job")),
        after.job_skills.unionByName(rows("skills")), after.candidates.unionByName(rows("candidates")), rest,
    )


def purge_archive(archive: DataFrame, now: datetime, days: int = KEPT_DAYS) -> DataFrame:
    return archive.where(F.col("deleted_at") >= F.lit(now) - F.expr(f"interval {int(days)} days"))


def list_archive(archive: DataFrame) -> DataFrame:
    """Archived listings, newest first, with title, company and source."""
    return archive.select("source_listing_id", "deleted_at", F.col("listing.source_title").alias("title"), F.col("listing.source_company_name").alias("company"), F.col("listing.source").alias("source")).orderBy(F.desc("deleted_at"), "source_listing_id")


def to_payload(archive: DataFrame) -> DataFrame:
    """The archive with its nested record as JSON text, as deleted_listings holds it."""
    return archive.select("source_listing_id", "deleted_at", F.to_json(F.struct("listing", "observations", "job", "skills", "candidates")).alias("payload"))
