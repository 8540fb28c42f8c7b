"""Pages by key: a page goes on after the last row of the one before, however deep it lies.

The order is a list of (column, descending); its last column must tell rows apart (an id). Nulls come first in ascending
order and last in descending order, as Spark sorts them. The condition on the leading column alone reaches the scan, so that
row groups before the page are skipped, and only `limit` rows a task are kept. A page too long for that is cut from ranges
that are sorted apart, so that no task holds it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import kept

Order = list[tuple[str, bool]]
#: Up to so many rows of a page a task holds at once.
PAGE_ROWS = 100_000


def _beyond(column: str, descending: bool, value: Any) -> Column:
    """Rows whose column comes strictly after value."""
    c = F.col(column)
    if value is None:
        return F.lit(False) if descending else c.isNotNull()
    return (c < F.lit(value)) | c.isNull() if descending else c > F.lit(value)


def after(order: Order, last: tuple) -> Column:
    """Rows that come after the one with these values of the order's columns."""
    (column, descending), value = order[0], last[0]
    beyond = _beyond(column, descending, value)
    if len(order) == 1:
        return beyond
    lead = beyond | F.col(column).eqNullSafe(F.lit(value))
    return lead & (beyond | (F.col(column).eqNullSafe(F.lit(value)) & after(order[1:], last[1:])))


def _sorted_by(order: Order) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]


def placed(rows: DataFrame, order: Order, limit: int, last: tuple | None = None) -> DataFrame:
    """The next `limit` rows with their place (from 1), in no order: ranges are sorted apart and placed after the rows of those before."""
    own = rows if last is None else rows.where(after(order, last))
    spark, by = rows.sparkSession, _sorted_by(order)
    numbered = kept(own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, offsets, n = F.shiftright("_at", 33), [], 0
    for at, size in sorted(tuple(r) for r in numbered.groupBy(part.alias("at")).count().collect()):  # a row a range
        offsets.append((at, n))
        n += size
    starts = F.broadcast(spark.createDataFrame(offsets, "_range long, _start long"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(starts, part == F.col("_range")).withColumn("place", place).where(F.col("place") <= limit).drop("_at", "_range", "_start")


def page(rows: DataFrame, order: Order, limit: int, last: tuple | None = None) -> DataFrame:
    """The next `limit` rows in this order, from the start or after the row with these values."""
    if limit > PAGE_ROWS:
        return placed(rows, order, limit, last).orderBy("place").drop("place")
    own = rows if last is None else rows.where(after(order, last))
    return own.orderBy(*_sorted_by(order)).limit(limit)


def cursor(shown: DataFrame, order: Order) -> tuple | None:
    """What the next page goes on after: the values of the last row of a page, or None after an empty page."""
    turned = shown.select(*[c for c, _ in order]).orderBy(*[F.col(c).asc() if descending else F.col(c).desc() for c, descending in order])
    row = turned.first()
    return None if row is None else tuple(row)
