"""Substring search by stored postings of character runs.

The normalised texts of listings are kept once each, with the listings that show them and with their distinct runs of 1 to 3
characters as postings, partitioned by a hash of the run. A needle's rarest runs tell the few texts that can hold it, and only those are
read and compared; needles of one or two characters are runs themselves. Any needle finds what a scan of all texts finds.

Cases: null and blank texts hold nothing; equal texts of many listings are one text; a blank needle finds every listing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import normalize_text
from hirelens.sources.shared import cleaned, kept, shared_dir

FIELDS, LONGEST, GROUPS = ("title", "company", "description_text"), 3, 16
#: Of a needle's runs the rarest are looked up.
LOOKUPS = 4


def runs_of(text: Column, longest: int = LONGEST) -> Column:
    """The distinct runs of 1 to `longest` characters."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, longest + 1)]))


def _group(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(GROUPS)).cast("int")


@dataclass
class TextIndex:
    """Folders of texts (text_key, text), places (id, text_key) and postings (run, text_key; by group), and counts of runs."""

    texts: DataFrame
    places: DataFrame
    postings: DataFrame
    counts: DataFrame

    def candidates(self, needle: str) -> DataFrame:
        """text_key of the texts that hold the needle's rarest runs. needle: normalised, not blank."""
        runs = sorted({needle[i : i + LONGEST] for i in range(max(len(needle) - LONGEST, 0) + 1)})
        spark = self.texts.sparkSession
        groups = [r[0] for r in spark.createDataFrame([(r,) for r in runs], "run string").select(_group(F.col("run"))).distinct().collect()]  # the needle's own
        known = {r["run"]: r["n"] for r in self.counts.where(F.col("group").isin(groups) & F.col("run").isin(runs)).collect()}  # a row a run of the needle
        if len(known) < len(runs):
            return self.texts.select("text_key").limit(0)
        rare = sorted(runs, key=lambda r: (known[r], r))[:LOOKUPS]
        own = self.postings.where(F.col("group").isin(groups) & F.col("run").isin(rare))
        return own.groupBy("text_key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("text_key")

    def matching(self, needle: str) -> DataFrame:
        """text_key of the texts that hold the needle."""
        hits = self.texts.join(self.candidates(needle), "text_key", "left_semi")
        return hits.where(F.col("text").contains(needle)).select("text_key")

    def search(self, view: DataFrame, source: str | None = None, role_family: str | None = None, q: str | None = None) -> DataFrame:
        """Rows of listing_view as search_listings gives them."""
        out = view if source is None else view.where(F.col("source") == source)
        out = out if role_family is None else out.where(F.col("role_family") == role_family)
        needle = " ".join((q or "").lower().split())
        if not needle:
            return out
        return out.join(self.places.join(self.matching(needle), "text_key", "left_semi").select("id").distinct(), "id", "left_semi")


def build(view: DataFrame, fields: tuple[str, ...] = FIELDS, folder: str | None = None) -> TextIndex:
    """Writes the index of listing_view's texts to the folder (a new shared one by default)."""
    spark = view.sparkSession
    base = folder or shared_dir(spark)
    each = view.select("id", F.explode(F.array_distinct(F.array(*[normalize_text(F.coalesce(f, F.lit(""))) for f in fields]))).alias("text")).where("text <> ''")
    hashed = F.unhex(F.sha2("text", 256))
    places = kept(each.select("id", hashed.alias("text_key")), f"{base}/places")
    texts = kept(each.select("text").distinct().select(hashed.alias("text_key"), "text"), f"{base}/texts")
    runs = texts.select("text_key", F.explode(runs_of(F.col("text"))).alias("run")).withColumn("group", _group(F.col("run")))
    with cleaned(spark):
        runs.repartitionByRange("group", "run", "text_key").sortWithinPartitions("group", "run").write.partitionBy("group").parquet(f"{base}/postings")
        postings = spark.read.parquet(f"{base}/postings")
        postings.groupBy("run", "group").agg(F.count("*").alias("n")).write.partitionBy("group").parquet(f"{base}/counts")
    return TextIndex(texts, places, postings, spark.read.parquet(f"{base}/counts"))
