"""The observation log as validity intervals, and active sets at many times in one pass.

A listing's observations are folded into intervals of one state (gaps and islands): at each time any active
observation makes it active, and equal states that follow each other are one interval. Before its first
observation, and without any, a listing counts as active. A set of times meets the intervals without the log.

Cases: rows with a null listing, time or state tell nothing; repeated rows change nothing; ties at one time as above;
an empty log gives no intervals, so every listing of an open job is active.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.schemas import Tables


def validity(observations: DataFrame) -> DataFrame:
    """(source_listing_id, active, valid_from, valid_to, last_at): states from valid_from until before valid_to (null: still).

    The first interval of a listing has no start: it is the time before its first observation. last_at is the last observation within.
    """
    known = observations.where("source_listing_id is not null and observed_at is not null and is_active is not null")
    states = known.groupBy("source_listing_id", "observed_at").agg(F.bool_or("is_active").alias("active"))
    order = Window.partitionBy("source_listing_id").orderBy("observed_at")
    before = F.lag("active").over(order)
    turns = states.withColumn("turn", before.isNull() | (before != F.col("active"))).withColumn("island", F.sum(F.col("turn").cast("int")).over(order))
    islands = turns.groupBy("source_listing_id", "island").agg(F.first("active").alias("active"), F.min("observed_at").alias("valid_from"), F.max("observed_at").alias("last_at"))
    closed = islands.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("source_listing_id").orderBy("island")))
    no = F.lit(None).cast("timestamp")
    own = F.struct("active", "valid_from", "valid_to", "last_at")
    first = F.struct(F.lit(True).alias("active"), no.alias("valid_from"), F.col("valid_from").alias("valid_to"), no.alias("last_at"))
    return closed.select("source_listing_id", F.inline(F.when(F.col("island") == 1, F.array(first, own)).otherwise(F.array(own))))


def extended(intervals: DataFrame, observations: DataFrame) -> DataFrame:
    """The intervals after a run's observations, without the log: only the last interval of a listing can change.

    A listing's new observations must not be older than the last one that its intervals know; an older one is an error, since
    what lies within an interval is no longer known.
    """
    last = intervals.where("valid_to is null")
    late = observations.join(last.select("source_listing_id", "last_at"), "source_listing_id").where(F.col("observed_at") < F.col("last_at"))
    if late.limit(1).count():
        raise ValueError("an observation is older than the last one of its listing: fold the log anew")
    touched = observations.select("source_listing_id").distinct()
    edge = F.explode(F.array_distinct(F.array("valid_from", "last_at")))
    known = last.join(touched, "source_listing_id", "left_semi").select("source_listing_id", edge.alias("observed_at"), F.col("active").alias("is_active"))
    again = validity(known.unionByName(observations.select("source_listing_id", "observed_at", "is_active")))
    fresh = again.join(last.select("source_listing_id", F.lit(True).alias("was")), "source_listing_id", "left").where(F.col("was").isNull() | F.col("valid_from").isNotNull()).drop("was")
    return intervals.join(touched.withColumn("new", F.lit(True)), "source_listing_id", "left").where(F.col("new").isNull() | F.col("valid_to").isNotNull()).drop("new").unionByName(fresh)


def active_at(t: Tables, intervals: DataFrame, times: list[datetime]) -> DataFrame:
    """(as_of, listing columns) of the listings that are active at each of the times (a parameter, not data).

    A job is open at a time before it closes.
    """
    at = F.array(*[F.lit(x) for x in times])
    within: Column = F.filter(at, lambda x: (F.col("valid_from").isNull() | (x >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (x < F.col("valid_to"))))
    seen = intervals.where("active").select("source_listing_id", F.explode(within).alias("as_of")).groupBy("source_listing_id").agg(F.collect_set("as_of").alias("times"))
    observed = intervals.where("valid_from is null").select("source_listing_id", F.lit(True).alias("observed"))
    jobs = t.jobs.select(F.col("id").alias("job_id"), "closed_at")
    rows = t.listings.join(seen, t.listings["id"] == seen["source_listing_id"], "left").drop("source_listing_id")
    rows = rows.join(observed, rows["id"] == observed["source_listing_id"], "left").drop("source_listing_id").join(jobs, "job_id")
    own = F.when(F.col("observed").isNull(), at).otherwise(F.coalesce("times", F.array().cast("array<timestamp>")))
    opened = F.filter(own, lambda x: F.col("closed_at").isNull() | (x < F.col("closed_at")))
    return rows.select(F.explode(opened).alias("as_of"), *t.listings.columns)
