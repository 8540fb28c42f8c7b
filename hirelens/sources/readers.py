"""Readers of target lists, taxonomies and landed API pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions.text import clean, distinct_by_key, filled, parse_iso, split_values
from hirelens.sources.shared import kept, shared_dir

TARGET = "company_name string, source string, board_token_or_site string, enabled string, notes string"
SEED = "skill_name string, category string, source_taxonomy string, alias string, match_type string, case_sensitive string"
#: Where a page of each source keeps its postings; "$" is the page itself.
ENVELOPES = {
    "lever": ("$",),
    "greenhouse": ("$.jobs",),
    "adzuna": ("$.results",),
    "careers_gov": ("$.results",),
    "jobstreet": ("$.data", "$.jobs", "$.results", "$.data.jobs", "$.data.results", "$.data.jobCards"),
}
#: Names that a taxonomy response uses for its list and fields.
LISTS = ("$.skills", "$.items", "$.results", "$.records", "$.data", "$.data.skills", "$.data.items", "$.data.results", "$.data.records")
NAMES = ("skill_name", "skillName", "name", "title", "competency_name", "competencyName")
CATEGORIES = ("category", "category_name", "categoryName", "skill_category", "skillCategory", "sector")
ALIASES = ("aliases", "alias", "synonyms", "synonym", "keywords", "keyword", "alternate_names", "alternateNames")
VERSIONS = ("version", "taxonomy_version", "taxonomyVersion", "release")
UPDATES = ("updated_at", "updatedAt", "last_updated", "lastUpdated", "last_modified", "lastModified", "source_updated_at")
ROOT_VERSIONS = ("version", "taxonomy_version", "release")
ROOT_UPDATES = ("updated_at", "last_updated", "lastUpdated", "source_updated_at")
LABELS = ("name", "title", "value", "label", "alias")
#: What opening a file counts as, so that a task reads some hundred small pages and not a few.
OPEN_COST, SMALL_FILE = "spark.sql.files.openCostInBytes", "65536"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def read_targets(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Enabled target companies, of one source if given."""
    rows = _csv(spark, path, TARGET)
    off = F.lower(clean("enabled")).isin("0", "false", "no", "n")
    rows = rows.select(*[clean(c).alias(c) for c in ("company_name", "source", "board_token_or_site")], (~off).alias("enabled"), filled("notes").alias("notes")).where("enabled")
    return rows if source is None else rows.where(F.col("source") == source)


def read_taxonomy_csv(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a seed file; rows without a skill name are rejected, or an error if strict."""
    rows = _csv(spark, path, SEED)
    name = filled("skill_name")
    if strict:
        name = F.coalesce(name, F.raise_error(F.lit("skill_name is missing")).cast("string"))
    records = rows.select(
        name.alias("skill_name"), filled("category").alias("category"), F.coalesce(filled("source_taxonomy"), F.lit("local")).alias("source_taxonomy"),
        F.coalesce(filled("alias"), filled("skill_name")).alias("alias"), F.coalesce(filled("match_type"), F.lit("literal")).alias("match_type"),
        F.lower(clean("case_sensitive")).isin("1", "true", "yes", "y").alias("case_sensitive"),
        F.lit(None).cast("string").alias("taxonomy_version"), F.lit(None).cast("timestamp").alias("source_updated_at"),
        F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).alias("pos"),
    )
    if strict:
        return records, records.limit(0)
    return records.where("skill_name is not null"), rows.where(filled("skill_name").isNull())


def json_list(text: Column, paths: tuple[str, ...]) -> Column:
    """The first path that holds a JSON list, as an array of JSON texts; null if none does."""
    at = [F.get_json_object(text, p) for p in paths]
    return F.coalesce(*[F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")) for x in at])


def _first_value(item: Column, names: tuple[str, ...]) -> Column:
    """The first non-blank text among fields; of a list or object the first text in it."""
    return F.coalesce(*[F.get(_texts(F.get_json_object(item, f"$.{n}")), F.lit(0)) for n in names])


def _texts(value: Column) -> Column:
    """Texts of a JSON value: a list gives its items', an object its label, a string its parts."""
    label = lambda x: F.coalesce(*[filled(F.get_json_object(x, f"$.{k}")) for k in LABELS])
    one = lambda x: F.when(F.ltrim(x).startswith("{"), F.array_compact(F.array(label(x)))).otherwise(split_values(x))
    many = F.flatten(F.transform(F.from_json(value, "array<string>"), one))
    return F.when(F.ltrim(value).startswith("["), many).otherwise(one(value))


def read_taxonomy_json(spark: SparkSession, path: str, source_taxonomy: str = "ssg_wsg") -> DataFrame:
    """Records, one for each skill and alias, of taxonomy responses (a file each) of any of the known shapes."""
    pages = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("file"))
    items = json_list(F.col("value"), ("$", *LISTS))
    items = F.coalesce(items, F.raise_error(F.lit("taxonomy response has no list of records")).cast("array<string>"))
    rows = pages.select("file", "value", F.posexplode(items).alias("row", "item"))
    name = F.coalesce(_first_value(F.col("item"), NAMES), F.raise_error(F.lit("taxonomy item without a skill name")).cast("string"))
    rows = rows.withColumn("skill_name", name)
    others = F.flatten(F.array(*[F.coalesce(_texts(F.get_json_object("item", f"$.{n}")), F.array().cast("array<string>")) for n in ALIASES]))
    named = distinct_by_key(F.concat(F.array("skill_name"), others))
    root = lambda names: _first_value(F.when(F.ltrim("value").startswith("{"), F.col("value")), names)
    return rows.select(
        "skill_name", _first_value(F.col("item"), CATEGORIES).alias("category"), F.lit(source_taxonomy).alias("source_taxonomy"),
        F.coalesce(_first_value(F.col("item"), VERSIONS), root(ROOT_VERSIONS)).alias("taxonomy_version"),
        parse_iso(F.coalesce(_first_value(F.col("item"), UPDATES), root(ROOT_UPDATES))).alias("source_updated_at"),
        F.posexplode(named).alias("place", "alias"), "file", "row",
    ).select(
        "skill_name", "category", "source_taxonomy", "alias", F.lit("literal").alias("match_type"), F.lit(False).alias("case_sensitive"),
        "taxonomy_version", "source_updated_at", F.struct("file", (F.col("row").cast("long") * 1_000_000 + F.col("place")).alias("row")).alias("pos"),
    )


def read_raw_postings(spark: SparkSession, path: str, source: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings: file, page_pos, posting; rejects: file, value) of landed pages, a file each.

    A page without its envelope is an error if strict, else a reject; an empty list adds nothing. Where pages lie in several
    folders, these are read one after another and what they hold is kept, so that the driver lists one folder's files at a time.
    """
    folders = _folders(spark, path)
    if len(folders) < 2:
        return _postings_of(_pages(spark, path), source, strict)
    base = shared_dir(spark)
    before = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, SMALL_FILE)
    try:
        for n, folder in enumerate(folders):
            for name, rows in zip(("postings", "rejects"), _postings_of(_pages(spark, folder), source, strict), strict=True):
                if name == "postings" or not strict:
                    kept(rows, f"{base}/{name}/part={n}")
    finally:
        spark.conf.set(OPEN_COST, before)
    postings = spark.read.schema("file string, page_pos int, posting string").option("recursiveFileLookup", True).parquet(f"{base}/postings")
    if strict:
        return postings, spark.createDataFrame([], "file string, value string")
    return postings, spark.read.schema("file string, value string").option("recursiveFileLookup", True).parquet(f"{base}/rejects")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in this one if it holds nothing else (but for hidden files), else the path itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found or len(found) != 1 or not found[0].isDirectory():
        return [path]
    listed = [x for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(found[0].getPath()) if not x.getPath().getName().startswith(("_", "."))]
    return sorted(x.getPath().toString() for x in listed) if listed and all(x.isDirectory() for x in listed) else [path]


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select("value", F.input_file_name().alias("file"))


def _postings_of(pages: DataFrame, source: str, strict: bool) -> tuple[DataFrame, DataFrame]:
    items = json_list(F.col("value"), ENVELOPES[source])
    if strict:
        items = F.coalesce(items, F.raise_error(F.concat(F.lit(f"no {source} postings in "), F.col("file"))).cast("array<string>"))
    rows = pages.withColumn("items", items)
    rejects = rows.where(F.col("items").isNull()).select("file", "value") if not strict else rows.limit(0).select("file", "value")
    return rows.select("file", F.posexplode("items").alias("page_pos", "posting")), rejects


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
