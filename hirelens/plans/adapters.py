"""Driver tables as the model tables: integer arithmetic, minima and maxima only, so that SQL elsewhere can repeat it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions.text import content_hash
from hirelens.schemas import Tables

AS_OF = datetime(2001, 8, 1)
SOURCES = ("lever", "greenhouse", "adzuna", "careers_gov", "jobstreet")
TITLES = (
    "Senior Data Engineer", "Data Scientist", "Machine Learning Engineer", "Senior Robotics Software Engineer", "Software Engineer II", "Product Manager", "Office Clerk", "Business Analyst", "UX Designer", "QA Engineer",
    "Project Manager", "DevOps Engineer", "Security Analyst", "Data Analyst", "Accountant", "LLM Engineer", "Backend Developer", "Sales Associate", "Big Data Engineer", "Cloud Engineer",
)
INTERVALS = (None, "monthly", "monthly", "Yearly", "hour", None, "weekly", "weekly")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("normalized_name"), F.col("c_mktsegment").alias("industry"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    later = lambda n: F.timestamp_add("DAY", n.cast("int"), day)
    title = pick(TITLES, k % 20)
    return o.select(
        k.alias("id"), F.when(k % 50 != 0, F.col("o_custkey")).alias("company_id"), title.alias("title"), F.lower(title).alias("normalized_title"),
        F.when(k % 7 == 0, "data_engineer").when(k % 11 == 0, "custom:ai_platform").alias("role_family_id"), F.concat(F.lit("https://example.test/jobs/"), k.cast("string")).alias("canonical_url"),
        F.when(k % 5 != 0, F.concat(F.lit("City "), (k % 2).cast("string"))).alias("location"), F.lit(None).cast("string").alias("workplace_type"), F.lit(None).cast("string").alias("description_text"),
        F.when(k % 4 != 0, F.concat(F.lit("h"), (k % 3).cast("string"))).alias("content_hash"), day.alias("first_seen_at"), later(k % 90).alias("last_seen_at"),
        F.when(F.col("o_orderstatus") == "F", later(k % 60 + 1)).alias("closed_at"), F.lit(None).cast("string").alias("raw_payload"),
    )


def description(k: Column, n: Column) -> Column:
    s = lambda x: x.cast("string")
    return F.concat(F.lit("Responsibilities: keep system number "), s(k % 3), F.lit(" of the platform running. Requirements: "), s((k + n) % 4 + 2), F.lit(" years of work with large tables."))


def _keys(k: Column, n: Column) -> dict[str, Column]:
    own = (k + n) % 3 != 0
    return {"id": k * 10 + n, "job_id": k, "source": pick(SOURCES, (k + n) % 5), "priced": own}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    # dealt by job, so that a join with jobs finds listings in place and their texts are not shuffled
    g = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.min("l_shipdate").cast("timestamp").alias("first_seen_at"), F.max("l_shipdate").cast("timestamp").alias("last_seen_at"))
    key, text, none = _keys(k, n), description(k, n), F.lit(None).cast("string")
    return g.select(
        key["id"].alias("id"), F.lit(None).cast("long").alias("ingestion_run_id"), key["job_id"].alias("job_id"), key["source"].alias("source"), key["id"].cast("string").alias("source_job_id"),
        F.concat(F.lit("https://example.test/jobs/"), k.cast("string")).alias("canonical_url"), F.concat(F.lit("https://example.test/listings/"), key["id"].cast("string")).alias("source_url"),
        F.when(n % 2 == 0, F.concat(F.lit("Agency "), (k % 10).cast("string"))).alias("source_company_name"), pick(TITLES, k % 20).alias("source_title"), none.alias("location"), none.alias("workplace_type"), text.alias("description_text"),
        F.when(key["source"].isin("adzuna", "jobstreet"), "snippet").otherwise("full_text").alias("text_quality"),
        F.when(key["priced"], F.floor(F.col("low") / 10).cast("double")).alias("salary_min"), F.when(key["priced"] & (n != 7), F.floor(F.col("high") / 8).cast("double")).alias("salary_max"),
        F.when(k % 4 == 0, "USD").otherwise("SGD").alias("salary_currency"), pick(INTERVALS, n).alias("salary_interval"), content_hash(text).alias("content_hash"), none.alias("raw_payload"),
        "first_seen_at", "last_seen_at", F.lit(None).cast("timestamp").alias("source_updated_at"),
    )


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as it is: listings that repeat an identity. The row id is a hash of the whole row."""
    rows = read(spark, sf_dir, "lineitem").distinct()
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    key = _keys(k, n)
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), (F.col("l_extendedprice") * 100).cast("long")).alias("id"), key["job_id"].alias("job_id"), key["source"].alias("source"), key["id"].cast("string").alias("source_job_id"), F.col("l_shipdate").cast("timestamp").alias("first_seen_at"), F.col("l_shipdate").cast("timestamp").alias("last_seen_at"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_listing_id"), F.col("l_shipdate").cast("timestamp").alias("observed_at"), (F.col("l_returnflag") != "R").alias("is_active"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("id")).distinct()
    name = F.concat(F.lit("skill_"), F.col("id").cast("string"))
    return ids.select("id", name.alias("name"), name.alias("normalized_name"), F.concat(F.lit("group_"), (F.col("id") % 4).cast("string")).alias("category"), F.lit("local").alias("source_taxonomy"))


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 40).alias("skill_id")).distinct()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(companies(spark, sf_dir), jobs(spark, sf_dir), listings(spark, sf_dir), observations(spark, sf_dir), skills(spark, sf_dir), job_skills(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion runs: one for each event type and day of the events."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    g = e.groupBy(F.date_trunc("day", "ts").alias("started_at"), F.col("event_type").alias("source")).agg(F.min("event_id").alias("id"), F.count("*").alias("n"))
    bad = F.col("n") % 3 == 0
    return g.select("id", "source", F.when(bad, "completed_with_errors").otherwise("completed").alias("status"), "started_at", F.when(bad, F.concat(F.lit("failed targets: "), (F.col("n") % 7).cast("string"))).alias("error_message"))


def aliases(spark: SparkSession, rows: list[tuple[int, int, str, bool]]) -> DataFrame:
    a = spark.createDataFrame(rows, "id long, skill_id long, alias string, case_sensitive boolean")
    return a.withColumns({"normalized_alias": F.lower("alias"), "match_type": F.lit("literal")})
