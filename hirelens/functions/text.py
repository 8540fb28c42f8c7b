"""Column functions on strings, numbers, times and salaries. No Python runs on rows here."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_TEXT = 20
#: Fixed value: the characters that Unicode calls white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: How many such intervals a year has.
INTERVALS_A_YEAR = {
    1: ("year", "yr", "annual", "annually", "yearly"),
    12: ("month", "mo", "monthly"),
    52: ("week", "weekly"),
    260: ("day", "daily"),
    2080: ("hour", "hr", "hourly"),
}
#: Names that an interval takes.
INTERVAL_NAMES = {1: "yearly", 12: "monthly", 2080: "hourly", 260: "daily", 52: "weekly"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: str | Column) -> Column:
    """Trimmed text, Unicode blanks too; null becomes empty."""
    return F.btrim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(BLANKS))


def filled(c: str | Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(clean(c), F.lit(""))


def first_filled(*cs: str | Column) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def to_float(c: str | Column) -> Column:
    return col(c).try_cast("double")


def truthy_float(*cs: Column) -> Column:
    """The first value that is neither missing nor zero, as a number."""
    return F.coalesce(*[F.nullif(col(c).try_cast("double"), F.lit(0.0)) for c in cs])


def parse_iso(c: str | Column) -> Column:
    """ISO-8601 to timestamp under a UTC session: Z or offset, or naive as UTC; bad is null."""
    text = filled(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def epoch_ms(c: str | Column) -> Column:
    return F.timestamp_millis(col(c).try_cast("bigint"))


def normalize_text(c: str | Column) -> Column:
    """Lower-cased with blanks collapsed: the key of joins and groups. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def normalize_query(c: str | Column) -> Column:
    return F.nullif(normalize_text(c), F.lit(""))


def substantive_text(c: str | Column) -> Column:
    return let(normalize_text(c), lambda text: F.when(F.length(text) >= SHORT_TEXT, text))


def content_hash(c: str | Column) -> Column:
    return F.when(col(c) != "", F.sha2(col(c), 256))


def salary_numbers(label: str | Column) -> Column:
    found = F.regexp_extract_all(col(label), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def interval_from_label(label: str | Column) -> Column:
    text = F.lower(col(label))
    return F.when(text.contains("month"), "monthly").when(text.contains("year") | text.contains("annum"), "yearly").when(text.contains("hour"), "hourly").when(text.contains("day"), "daily")


def normalize_interval(c: str | Column) -> Column:
    text = F.lower(clean(c))
    named = reduce(lambda out, k: out.when(text.isin(*INTERVALS_A_YEAR[k]), INTERVAL_NAMES[k]), INTERVAL_NAMES, F.when(F.lit(False), ""))
    return F.coalesce(named, interval_from_label(c), F.nullif(col(c), F.lit("")))


def join_labels(items: Column, sep: str) -> Column:
    """Non-blank trimmed strings of an array, joined; null if there are none."""
    return F.nullif(F.array_join(F.filter(F.transform(items, clean), lambda x: x != ""), sep), F.lit(""))


def resolve_url(base: str, c: str | Column) -> Column:
    """A URL against a fixed base https://host/."""
    url = filled(c)
    host = base.rstrip("/")
    return F.when(F.lower(url).rlike(r"^[a-z][a-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(host), url)).otherwise(F.concat(F.lit(f"{host}/"), url))


def closed_midpoint(low: str | Column, high: str | Column) -> Column:
    return (col(low) + col(high)) / 2


def loose_midpoint(low: str | Column, high: str | Column) -> Column:
    return F.coalesce((col(low) + col(high)) / 2, col(low), col(high))


def intervals_a_year(interval: str | Column) -> Column:
    text = F.lower(F.trim(col(interval)))
    return reduce(lambda out, k: out.when(text.isin(*INTERVALS_A_YEAR[k]), F.lit(k)), INTERVALS_A_YEAR, F.when(F.lit(False), F.lit(1)))


def annualized_midpoint(low: str | Column, high: str | Column, interval: str | Column) -> Column:
    return closed_midpoint(low, high) * intervals_a_year(interval)


def salary_key(low: str | Column, high: str | Column, currency: str | Column, interval: str | Column) -> Column:
    """A key by which equal salaries group; nulls are equal."""
    return F.struct(F.round(col(low), 2).alias("low"), F.round(col(high), 2).alias("high"), normalize_text(currency).alias("currency"), normalize_text(interval).alias("interval"))


def has_salary(low: str | Column = "salary_min", high: str | Column = "salary_max") -> Column:
    return col(low).isNotNull() | col(high).isNotNull()


def week_start(ts: str | Column) -> Column:
    """The Monday of the ISO week."""
    return F.date_trunc("week", col(ts)).cast("date")


def linear_percentile(c: str | Column, *shares: float) -> Column:
    """Exact percentiles with linear interpolation, as an array."""
    return F.percentile(col(c), F.array(*[F.lit(s) for s in shares]))


def delta_percent(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.nullif(before, F.lit(0)))


def split_values(c: str | Column) -> Column:
    """Parts of a string at commas, or else at semicolons; blank parts dropped."""
    text = col(c)
    parts = F.when(text.contains(","), F.split(text, ",")).otherwise(F.split(text, ";"))
    return F.filter(F.transform(parts, clean), lambda x: x != "")


def distinct_by_key(values: Column) -> Column:
    """An array without later values whose normalised text came before."""
    keys = F.transform(values, normalize_text)
    return F.filter(values, lambda v, i: F.array_position(keys, normalize_text(v)) == i + 1)
