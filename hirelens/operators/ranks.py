"""Exact percentiles of groups of any size: values are ranged over tasks and ranks follow from prefix counts.

No task holds a group's values: they are counted, ranged by (group, value) and numbered within their range, and a range
begins where the counts of the ranges before it end. A percentile is read off at its two ranks, so what an aggregate keeps is a
pair of values for each percentile asked for.

Cases: null values do not count; a group of nulls only has no row; a group of one value has that value; ties share their ranks; a null group is a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.sources.shared import kept


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """(by, count, one column for each share) with linear interpolation on (n - 1) * share. weight: how often a row counts."""
    n = F.sum(weight) if weight else F.count("*")
    keys = [F.coalesce(F.to_json(F.struct(*by)), F.lit("")).alias("_group")]  # nulls are told from texts
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(n.alias("_n")).select("*", *keys)
    ranged = kept(counted.repartitionByRange("_group", "_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_group", "_part").agg(F.sum("_n").alias("_own"))  # a row for each range of a group
    order = Window.partitionBy("_group").orderBy("_part")
    starts = parts.select("_group", "_part", (F.sum("_own").over(order) - F.col("_own")).alias("_before"), F.sum("_own").over(Window.partitionBy("_group")).alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy("_group", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("_upto", upto).join(starts, ["_group", "_part"])
    last, first = F.col("_before") + F.col("_upto"), F.col("_before") + F.col("_upto") - F.col("_n")
    found, out = [F.max("_total").alias("count")], []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        reads = lambda rank: F.max(F.when((first <= rank) & (rank < last), F.col("_v")))
        found += [reads(low).alias(f"{name}_low"), reads(high).alias(f"{name}_high"), F.max(at - low).alias(f"{name}_rest")]
        out.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_rest")).alias(name))
    return placed.groupBy(*by).agg(*found).select(*by, "count", *out)
