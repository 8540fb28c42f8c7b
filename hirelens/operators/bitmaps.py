"""Exact distinct counts that can be kept up to date: bitmaps of numbers, merged run by run.

A set of job numbers is kept as bitmaps of 32,768 numbers each (bucket, bits). Bitmaps of two runs merge by OR,
so a count over any runs needs neither their rows nor their order, and a run that comes twice changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.operators.trends import in_window, week_spine, with_deltas
from hirelens.schemas import Tables
from hirelens.sources.shared import kept

#: A row's place in its partition, within what monotonically_increasing_id gives.
_PLACE = (1 << 33) - 1


def number_jobs(known: DataFrame, ids: DataFrame) -> DataFrame:
    """known (job_id, number) with the new ids of `ids` (job_id) numbered on from the greatest number, without gaps.

    New ids are ranged over partitions; how many each holds (one row a partition) is all that has to meet in one place.
    """
    new = ids.where("job_id is not null").select("job_id").distinct().join(known.select("job_id"), "job_id", "left_anti")
    placed = kept(new.repartitionByRange("job_id").sortWithinPartitions("job_id").select("job_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(_PLACE).alias("at")))
    start = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    offsets = []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], start))
        start += r["count"]
    before = known.sparkSession.createDataFrame(offsets, "part int, first long")
    numbered = placed.join(F.broadcast(before), "part").select("job_id", (F.col("first") + F.col("at")).alias("number"))
    return kept(known.select("job_id", "number").unionByName(numbered))


def bitmaps_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, bits) of the numbers of each group; numbers start at 0."""
    n = (F.col("number") + 1).cast("long")
    return rows.groupBy(*by, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def merged(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts_of(bitmaps: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct numbers of each group, over bitmaps of any number of runs."""
    whole = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def weekly_active(t: Tables, observations: DataFrame, numbers: DataFrame) -> DataFrame:
    """(week, bucket, bits): jobs with an active observation among these, by week."""
    week = F.date_trunc("week", "observed_at").cast("date").alias("week")
    seen = observations.where("is_active").select(week, F.col("source_listing_id").alias("id")).distinct()
    rows = seen.join(t.listings.select("id", "job_id"), "id").join(numbers, "job_id")
    return bitmaps_of(rows.select("week", "number"), ["week"])


def skill_bitmaps(t: Tables, numbers: DataFrame) -> DataFrame:
    """(skill, bucket, bits): jobs that ask for a skill, by its name."""
    names = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill"))
    rows = t.job_skills.join(names, "skill_id").join(numbers, "job_id")
    return bitmaps_of(rows.select("skill", "number"), ["skill"])


def skill_demand(weekly: DataFrame, skills: DataFrame, names: DataFrame, as_of: datetime, weeks: int = 12) -> DataFrame:
    """The weekly demand of every skill, from stored bitmaps alone: weeks and skills meet bucket by bucket.

    names: skill, of all skills; weeks without a job stay, with zero.
    """
    inside = weekly.where(in_window("week", as_of, weeks)).groupBy("week", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = inside.join(skills.select("skill", "bucket", F.col("bits").alias("own")), "bucket")
    # AND by De Morgan is not among the bitmap functions: |a and b| = |a| + |b| - |a or b|
    pair = both.select("skill", "week", "bucket", "bits", F.explode(F.array("bits", "own")).alias("x")).groupBy("skill", "week", "bucket").agg(F.sum(F.bitmap_count("x")).alias("both"), F.bitmap_count(F.bitmap_or_agg("x")).alias("any"))
    counts = pair.groupBy("skill", "week").agg(F.sum(F.col("both") - F.col("any")).alias("job_count"))
    grid = names.select("skill").distinct().crossJoin(F.broadcast(week_spine(names.sparkSession, as_of, weeks)))  # weeks is a parameter
    return with_deltas(grid.join(counts, ["skill", "week"], "left").fillna(0, ["job_count"]), "job_count", ["skill"])
