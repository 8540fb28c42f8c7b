"""The life of a listing as keyed state: misses, closing and reopening without a look back at the log.

A run polls every `every`; a listing that a run finds is an observation at the run's time. State holds, by
listing, when it was last found and how many runs have missed it since, and a timer for the run that should
find it next. A timer that goes off is a miss; `most` misses close the listing, and being found again opens it.
A run that finds a listing first settles the misses before it, so the events are the same however the runs
are split into micro-batches. A run's end is told by a row without a listing, which moves the watermark on.

Rows that come late (at or before the last time the listing was found) change nothing; a row with a null
time, or one that is not active, is no sighting; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hirelens.operators.ingest import MISSES_TO_CLOSE
from hirelens.streaming.observations import each_batch

POLL = "source_listing_id long, observed_at timestamp, is_active boolean"
EVENT = "source_listing_id long, at timestamp, event string, misses int"
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Lifecycle(StatefulProcessor):
    """Emits `found` (first, or after misses), `missed`, `closed` and `reopened` of one listing."""

    def __init__(self, every: timedelta, most: int) -> None:
        self.every, self.most = int(every.total_seconds() * 1000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "last long, misses int")

    def _due(self, last: int, misses: int) -> int:
        """The latest time of the run that should find it next: polls may be a quarter of an interval late."""
        return last + (misses + 1) * self.every + self.every // 4

    def _missed(self, key: int, last: int, misses: int, until: int) -> tuple[int, list[tuple]]:
        """Misses of runs that are over by `until`."""
        events = []
        while misses < self.most and self._due(last, misses) < until:
            misses += 1
            at = last + misses * self.every
            events.append((key, at, "missed", misses))
            if misses == self.most:
                events.append((key, at, "closed", misses))
        return misses, events

    def _wait(self, last: int, misses: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if misses < self.most:
            self.handle.registerTimer(self._due(last, misses))

    def _frame(self, events: list[tuple]) -> Iterator[pd.DataFrame]:
        if events:
            out = pd.DataFrame(events, columns=["source_listing_id", "at", "event", "misses"])
            yield out.assign(at=pd.to_datetime(out["at"], unit="ms").astype("datetime64[us]"), misses=out["misses"].astype("int32"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        times = sorted({t.value // 1_000_000 for frame in rows for t in pd.to_datetime(frame.loc[frame["is_active"].fillna(False).astype(bool), "at_us"], unit="us").dropna()})
        events: list[tuple] = []
        last, misses = self.life.get() if self.life.exists() else (None, 0)
        for at in times:
            if last is None:
                events.append((key[0], at, "found", 0))
            elif at <= last:
                continue
            else:
                misses, own = self._missed(key[0], last, misses, at)
                events += own
                if misses:
                    events.append((key[0], at, "reopened" if misses >= self.most else "found", 0))
            last, misses = at, 0
        if times and last is not None:
            self.life.update((last, misses))
            self._wait(last, misses)
        yield from self._frame(events)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        last, misses = self.life.get()
        misses, events = self._missed(key[0], last, misses, timerValues.getCurrentWatermarkInMs() + 1)  # all that is due, not this timer alone
        self.life.update((last, misses))
        self._wait(last, misses)
        yield from self._frame(events)

    def close(self) -> None:
        pass


def listing_events(polls: DataFrame, every: timedelta, most: int = MISSES_TO_CLOSE, delay: str = "0 seconds") -> DataFrame:
    """The stream of EVENT rows of a stream of POLL rows."""
    marked = polls.withWatermark("observed_at", delay)
    rows = marked.select(F.coalesce("source_listing_id", F.lit(-1)).alias("source_listing_id"), "observed_at", F.unix_micros("observed_at").alias("at_us"), (F.col("is_active") & F.col("source_listing_id").isNotNull()).alias("is_active"))
    return rows.groupBy("source_listing_id").transformWithStateInPandas(statefulProcessor=Lifecycle(every, most), outputStructType=EVENT, outputMode="Update", timeMode="EventTime")


def follow(spark: SparkSession, landing: str, events: str, checkpoint: str, every: timedelta, most: int = MISSES_TO_CLOSE) -> StreamingQuery:
    """Takes in what has landed since the last call and writes its events by micro-batch (a repeated one replaces itself)."""
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        polls = spark.readStream.schema(POLL).parquet(landing)
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{events}/batch={n}")
        return each_batch(listing_events(polls, every, most), write, checkpoint, "update")
    finally:
        spark.conf.set(ROCKSDB[0], before) if before else spark.conf.unset(ROCKSDB[0])


def listing_states(events: DataFrame, most: int = MISSES_TO_CLOSE) -> DataFrame:
    """(source_listing_id, misses, closed, closings) from the events of all batches: the last event tells."""
    order = F.struct("at", F.col("misses"), (F.col("event") == "closed").alias("closed"))
    last = F.max(order)
    return events.groupBy("source_listing_id").agg(last.getField("misses").alias("misses"), F.count_if(F.col("event") == "closed").alias("closings")).withColumn("closed", F.col("misses") >= most)


def closed_jobs(listings: DataFrame, states: DataFrame) -> DataFrame:
    """job_id of jobs with a closed listing and none that its last run found, or that no run has looked for."""
    owned = listings.where("job_id is not null").select("job_id", F.col("id").alias("source_listing_id")).join(states, "source_listing_id", "left")
    idle = F.bool_and(F.coalesce(F.col("misses") > 0, F.lit(False)))
    return owned.groupBy("job_id").agg(idle.alias("idle"), F.bool_or(F.coalesce("closed", F.lit(False))).alias("due")).where("idle and due").select("job_id")
