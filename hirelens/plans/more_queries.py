"""More registered queries: column functions, readers and normalisers on landed files, report bundles, whole ingestion runs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions import roles, sections, text
from hirelens.operators import active, archive, dedupe, ingest, matching, overview, trends
from hirelens.plans import adapters as A
from hirelens.plans.queries import _BATCH, _COMPANIES, _PAIRS, _SEGMENT, _WEEKS, AS_OF, WEEKS, _batch, day, query
from hirelens.sources import normalize, readers, sinks
from hirelens.sources.shared import shared_dir

S = lambda c: F.col(c).cast("string")


def pick(index: Column, *values: str | None) -> Column:
    return A.pick(values, index)


# column functions


@query("select c_custkey id, c_name cleaned, case when c_custkey % 5 <> 0 then c_custkey + 0.5 end number, sha256(c_name) hash, 'customer ' || c_custkey normalized, case when c_custkey % 3 <> 0 then 'q ' || c_custkey end normalized_query, case when c_custkey % 2 = 0 then 'a longer text of customer ' || c_custkey end substantive from customer", model=False)
def f1_text_functions(spark, d):
    """F1 clean, F2 to_float, F8 content_hash, F28 normalize_query, F33 substantive_text."""
    c, k = A.read(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("id"), text.clean(F.concat(F.lit(" \t"), "c_name", F.lit(" \n"))).alias("cleaned"), text.to_float(F.when(k % 5 == 0, "n/a").otherwise(F.concat(S("c_custkey"), F.lit(".5")))).cast("decimal(20,1)").alias("number"), text.content_hash("c_name").alias("hash"),
        text.normalize_text(F.concat(F.lit(" Customer \n\t "), S("c_custkey"), F.lit(" "))).alias("normalized"), text.normalize_query(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" Q  "), S("c_custkey")))).alias("normalized_query"),
        text.substantive_text(F.when(k % 2 == 0, F.concat(F.lit(" A longer  TEXT of customer "), S("c_custkey"))).otherwise(F.lit("short"))).alias("substantive"),
    )


@query("select o_orderkey id, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M') when 1 then strftime(o_orderdate - interval 8 hour, '%Y-%m-%d %H:%M') end parsed, strftime(epoch_ms(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') from_epoch, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week from orders", model=False)
def f3_time_functions(spark, d):
    """F3 parse_iso_datetime, F4 epoch_ms, F23 iso_week_start."""
    o, k = A.read(spark, d, "orders"), F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(k % 3 == 0, F.concat(stamp, F.lit("Z"))).when(k % 3 == 1, F.concat(F.lit(" "), stamp, F.lit("+08:00"))).otherwise(F.concat(F.lit("on "), stamp))
    return o.select(k.alias("id"), F.date_format(text.parse_iso(shown), "yyyy-MM-dd HH:mm").alias("parsed"), F.date_format(text.epoch_ms((k * 1_000_000).cast("string")), "yyyy-MM-dd HH:mm:ss").alias("from_epoch"), day_of(text.week_start("o_orderdate")).alias("week"))


def day_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("select p_partkey id, cast((p_partkey % 9 + 1) * 1000 + 500 as double) low, cast((p_partkey % 9 + 2) * 1000 + 0.5 as double) high, ['monthly', 'yearly', 'hourly', 'daily', null][p_partkey % 5 + 1] label_interval, ['yearly', 'monthly', 'hourly', 'daily', 'fortnight'][p_partkey % 5 + 1] named_interval from part", model=False)
def f9_salary_labels(spark, d):
    """F9 parse_salary_label, F10 interval_from_label, F11 normalize_interval."""
    p, k = A.read(spark, d, "part"), F.col("p_partkey")
    n = lambda x: (k % 9 + x).cast("string")
    label = F.concat(F.lit("S$"), n(1), F.lit(",500 - $"), n(2), F.lit(",000.50 "), pick(k % 5, "per Month", "a year", "per hour", "per day", "in all"))
    numbers = text.salary_numbers(label)
    return p.select(k.alias("id"), F.get(numbers, F.lit(0)).alias("low"), F.get(numbers, F.lit(1)).alias("high"), text.interval_from_label(label).alias("label_interval"), text.normalize_interval(pick(k % 5, "Yr", " MO ", "hourly rate", "daily", "fortnight")).alias("named_interval"))


@query("""select s_suppkey id, s_name || '; ' || 'b' joined, ['https://boards.test/job/', 'https://boards.test/job/', 'https://x.test/', 'https://c.test/'][s_suppkey % 4 + 1] || s_suppkey url,
  'x' || s_suppkey || '|y|z' parts, 'Go|SQL ' || s_suppkey distinct_parts from supplier""", model=False)
def f12_lists_and_urls(spark, d):
    """F12 join_labels, F13 resolve_url, F27 split_alias_values and the distinct values of a list."""
    s, k = A.read(spark, d, "supplier"), F.col("s_suppkey")
    items = F.array(F.concat(F.lit("  "), "s_name"), F.lit(" "), F.lit(None).cast("string"), F.lit("b "))
    url = F.concat(pick(k % 4, "/job/", "job/", "https://x.test/", "//c.test/"), S("s_suppkey"))
    values = F.concat(F.lit("Go, go ,SQL "), S("s_suppkey"), F.lit(",, sql  "), S("s_suppkey"))
    return s.select(k.alias("id"), text.join_labels(items, "; ").alias("joined"), text.resolve_url("https://boards.test/", url).alias("url"), F.array_join(text.split_values(F.concat(F.lit("x"), S("s_suppkey"), F.lit("; y;; z "))), "|").alias("parts"), F.array_join(text.distinct_by_key(text.split_values(values)), "|").alias("distinct_parts"))


@query("""select id, (salary_min + salary_max) / 2 closed, coalesce((salary_min + salary_max) / 2, salary_min, salary_max) loose, salary_min is not null or salary_max is not null paid,
  salary_min - salary_max as delta, round(case when salary_max <> 0 then (salary_min - salary_max) / salary_max end, 6) delta_percent from listings""")
def f15_midpoints(spark, d):
    """F15 closed_midpoint, F16 loose_midpoint, A5 has_salary, F30 delta and delta_percent."""
    low, high = F.col("salary_min"), F.col("salary_max")
    return A.listings(spark, d).select("id", text.closed_midpoint(low, high).alias("closed"), text.loose_midpoint(low, high).alias("loose"), text.has_salary().alias("paid"), (low - high).alias("delta"), F.round(text.delta_percent(low, high), 6).alias("delta_percent"))


@query("select coalesce(c.name, l.source_company_name, 'UNKNOWN') company, count(*) listings from listings l join jobs j on j.id = l.job_id left join companies c on c.id = j.company_id group by 1")
def a6_company_of_listing(spark, d):
    t = A.tables(spark, d)
    return active.listing_facts(t, t.listings).groupBy("company").agg(F.count("*").alias("listings"))


@query("select round(salary_min, 2) low, round(salary_max, 2) high, lower(salary_currency) currency, lower(salary_interval) as interval, count(*) listings from listings group by all")
def f32_salary_key(spark, d):
    key = text.salary_key("salary_min", "salary_max", F.concat(F.lit(" "), "salary_currency"), F.upper("salary_interval"))
    return A.listings(spark, d).groupBy(key.alias("k")).agg(F.count("*").alias("listings")).select("k.*", "listings")


@query("select p_partkey id, 'senior ' || trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9+#.]', ' ', 'g'), '\\s+', ' ', 'g')) || ' c++ x' title, 'custom:ai_team_' || (p_partkey % 50) family, 'AI Team ' || (p_partkey % 50) label, case when p_partkey % 2 = 0 then 'DevOps API' end other_label from part", model=False)
def f18_role_functions(spark, d):
    """F18 normalize_title, F20 custom_family_id, F21 custom_family_label (null for ids that are not valid)."""
    p, k = A.read(spark, d, "part"), F.col("p_partkey")
    family = roles.custom_family_id(F.concat(F.lit(" AI--Team #"), (k % 50).cast("string"), F.lit("! ")))
    return p.select(k.alias("id"), roles.normalize_title(F.concat(F.lit("  Senior / "), "p_type", F.lit(" (C++)  - X "))).alias("title"), family.alias("family"), roles.custom_family_label(family).alias("label"), roles.custom_family_label(F.when(k % 2 == 0, "custom:devops_api").otherwise("custom:DevOps")).alias("other_label"))


@query(_WEEKS + "select strftime(week, '%Y-%m-%d') as week, (select count(*) from jobs where cast(date_trunc('week', first_seen_at) as date) = week) as jobs, (select count(*) from jobs where first_seen_at >= timestamp '2001-07-30' - interval 175 day and first_seen_at < timestamp '2001-08-06') in_window from spine")
def f24_week_spine(spark, d):
    """Every week of the window, with the jobs first seen in it."""
    spine, jobs = trends.week_spine(spark, AS_OF, WEEKS), A.jobs(spark, d)
    rows = jobs.where(trends.in_window("first_seen_at", AS_OF, WEEKS)).groupBy(text.week_start("first_seen_at").alias("week")).agg(F.count("*").alias("jobs"))
    out = spine.join(rows, "week", "left").fillna(0, ["jobs"])
    return out.crossJoin(out.agg(F.sum("jobs").alias("in_window"))).withColumn("week", day("week"))  # one row


_GO = ("We go live in", "Written in Go since", "golang of", "go-to-market of", "Cargo of", "C++ and Go, of")


@query("select c_custkey id, c_custkey % 6 in (1, 5) go, c_custkey % 6 = 5 cpp, c_custkey % 6 = 1 exact_case from customer", model=False)
def f25_alias_patterns(spark, d):
    """F25 alias_pattern and F26 go_exception: Go the language, not the verb; C++; and a case-sensitive alias."""
    c, k = A.read(spark, d, "customer"), F.col("c_custkey")
    body = F.concat(pick(k % 6, *_GO), F.lit(" "), S("c_custkey"))
    has = lambda alias, case=False: F.regexp_like(body, matching.alias_pattern(F.lit(alias), F.lit(case)))
    return c.select(k.alias("id"), has("go").alias("go"), has("c++").alias("cpp"), has("Written", True).alias("exact_case"))


@query("select l_returnflag flag, round(quantile_cont(l_extendedprice, 0.25), 4) p25, round(quantile_cont(l_extendedprice, 0.5), 4) median, round(quantile_cont(l_extendedprice, 0.9), 4) p90 from lineitem group by 1", model=False)
def f29_percentiles(spark, d):
    p = F.round(F.get("p", F.lit(0)), 4)
    out = A.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(text.linear_percentile("l_extendedprice", 0.25, 0.5, 0.9).alias("p"))
    return out.select("flag", p.alias("p25"), F.round(F.get("p", F.lit(1)), 4).alias("median"), F.round(F.get("p", F.lit(2)), 4).alias("p90"))


@query("select id, case when id % 2 = 0 then 'stored ' || id else 'keep system number ' || resp || ' of the platform running.' end responsibilities from listings")
def f31_sections_of_listing(spark, d):
    """Sections of the payload where it has them, else those of the description."""
    payload = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.create_map(F.lit(sections.RESPONSIBILITIES), F.concat(F.lit("stored "), S("id"))).alias("structured_sections"))))
    return A.listings(spark, d).select("id", sections.sections_of_listing(payload, "description_text")[sections.RESPONSIBILITIES].alias("responsibilities"))


_PAGE = "'<div><p>Page ' || page_id || ' &amp; more</p><p> of  text </p></div>'"


@query("select page_id, 'Page ' || page_id || ' & more of  text' text from pages", model=False)
def f5_html_text_of_known_pages(spark, d):
    from hirelens.functions.html import html_to_text

    return A.read(spark, d, "pages").select("page_id", html_to_text(F.expr(_PAGE)).alias("text"))


@query("select page_id, 'Page ' || page_id || ' & more of text' text from pages", model=False)
def f6_sanitized_text_of_known_pages(spark, d):
    from hirelens.functions.html import sanitize_text

    return A.read(spark, d, "pages").select("page_id", sanitize_text(F.expr(_PAGE)).alias("text"))


# sources: files that Spark writes from the tables, read back


@query("select c_name company_name, ['lever', 'greenhouse'][c_custkey % 2 + 1] as source, 'site-' || c_custkey site from customer where c_custkey % 5 <> 0", model=False)
def io1_read_targets(spark, d):
    """Targets of every customer; each fifth is switched off."""
    c, k = A.read(spark, d, "customer"), F.col("c_custkey")
    path = shared_dir(spark)
    c.select(F.concat(F.lit(" "), "c_name").alias("company_name"), pick(k % 2, "lever", "greenhouse").alias("source"), F.concat(F.lit("site-"), S("c_custkey")).alias("board_token_or_site"), pick(k % 5, "No", "yes", "1", "true", "").alias("enabled"), F.lit(None).cast("string").alias("notes")).write.option("header", True).csv(path)
    return readers.read_targets(spark, path).select("company_name", "source", F.col("board_token_or_site").alias("site"))


def _seed(spark, d) -> str:
    """A seed file of the parts: types as skills, brands as categories and aliases."""
    p, k = A.read(spark, d, "part"), F.col("p_partkey")
    path = shared_dir(spark)
    p.select(F.when(k % 10 != 0, F.col("p_type")).alias("skill_name"), F.lit(" Parts ").alias("category"), F.lit("").alias("source_taxonomy"), F.when(k % 2 == 0, F.col("p_brand")).alias("alias"), F.lit(None).cast("string").alias("match_type"), pick(k % 3, "Yes", "no", "").alias("case_sensitive")).write.option("header", True).csv(path)
    return path


@query("select p_type skill_name, 'Parts' category, 'local' source_taxonomy, case when p_partkey % 2 = 0 then p_brand else p_type end as alias, 'literal' match_type, p_partkey % 3 = 0 case_sensitive, count(*) n, (select count(*) from part where p_partkey % 10 = 0) rejected from part where p_partkey % 10 <> 0 group by all", model=False)
def io2_read_taxonomy_csv(spark, d):
    records, rejects = readers.read_taxonomy_csv(spark, _seed(spark, d))
    counted = records.groupBy("skill_name", "category", "source_taxonomy", "alias", "match_type", "case_sensitive").agg(F.count("*").alias("n"))
    return counted.crossJoin(rejects.agg(F.count("*").alias("rejected")))  # one row


def _responses(spark, d) -> str:
    """Taxonomy responses of three shapes: a page for each nation's suppliers."""
    s, k = A.read(spark, d, "supplier"), F.col("s_suppkey")
    item = F.when(k % 2 == 0, F.to_json(F.struct(F.col("s_name").alias("skillName"), F.lit("Trade").alias("sector"), F.array(F.concat(F.lit("alias "), S("s_suppkey")), "s_name").alias("synonyms"))))
    item = F.coalesce(item, F.to_json(F.struct(F.col("s_name").alias("title"), F.concat(F.lit("alias "), S("s_suppkey"), F.lit("; other "), S("s_suppkey")).alias("keywords"))))
    pages = s.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"))
    shape = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("["), "items", F.lit("]"))).when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit('{"version":"v7","skills":['), "items", F.lit("]}"))).otherwise(F.concat(F.lit('{"release":"v8","data":{"items":['), "items", F.lit("]}}")))
    path = shared_dir(spark)
    pages.select(shape.alias("value"), F.col("s_nationkey").alias("page")).write.partitionBy("page").text(path)
    return path


_TAXONOMY = "with items as (select s_name skill_name, case when s_suppkey % 2 = 0 then 'Trade' end category, [null, 'v7', 'v8'][s_nationkey % 3 + 1] taxonomy_version, unnest(case when s_suppkey % 2 = 0 then [s_name, 'alias ' || s_suppkey] else [s_name, 'alias ' || s_suppkey, 'other ' || s_suppkey] end) as alias from supplier) "


@query(_TAXONOMY + "select skill_name, category, taxonomy_version, alias, 'ssg_wsg' source_taxonomy from items", model=False)
def io3_read_taxonomy_json(spark, d):
    return readers.read_taxonomy_json(spark, _responses(spark, d)).select("skill_name", "category", "taxonomy_version", "alias", "source_taxonomy")


@query("select page_id as page, i as place, 'job ' || page_id || '-' || i title from pages cross join (select unnest(range(3)) i)", model=False)
def io4_read_raw_postings(spark, d):
    """A landed page of three postings for each web page."""
    pages = A.read(spark, d, "pages")
    items = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("job "), F.col("page_id").cast("string"), F.lit("-"), i.cast("string")).alias("title"), F.col("page_id").alias("page"), F.lit("[x]").alias("note")))
    path, landed = shared_dir(spark), pages.select(F.to_json(F.struct(items.alias("results"))).alias("value"), "page_id")
    for n in range(16):  # a folder at a time, as a write tells the driver of each page it made
        landed.where(F.pmod("page_id", F.lit(16)) == n).repartition(8, "page_id").write.partitionBy("page_id").text(f"{path}/folder={n}")
    rows, _ = readers.read_raw_postings(spark, path, "adzuna")
    return rows.select(F.get_json_object("posting", "$.page").cast("long").alias("page"), F.col("page_pos").cast("long").alias("place"), F.get_json_object("posting", "$.title").alias("title"))


@query("select source, count(*) rows, cast(sum(id) as bigint) ids from listings group by 1")
def io6_write_tables(spark, d):
    """Listings by source, written twice: the second run only replaces the partitions it has."""
    path, rows = shared_dir(spark), A.listings(spark, d).select("id", "source")
    sinks.write_table(rows, path, "source")
    sinks.write_table(rows.where(F.col("source") == "lever"), path, "source")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("select id from jobs except select job_id from listings union select -id from companies")
def u1_set_operations(spark, d):
    """Union of frames and difference of sets: jobs without a listing, and companies with negative ids."""
    bare = A.jobs(spark, d).select("id").join(A.listings(spark, d).select(F.col("job_id").alias("id")), "id", "left_anti").distinct()
    return readers.union_all([bare, A.companies(spark, d).select((-F.col("id")).alias("id"))])


# normalisers


def _postings(df: DataFrame, body: Column, *more: Column) -> DataFrame:
    return df.select(F.to_json(body).alias("posting"), *more)


_KEY = "l_orderkey * 10 + l_linenumber"


def _lines(spark, d) -> DataFrame:
    return A.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).distinct()


@query(f"select distinct 'site:' || ({_KEY}) source_job_id, 'Acme' company_name, 'Role ' || ({_KEY}) title, 'https://j.test/' || ({_KEY}) url, 'Oslo' as location, 'About ' || ({_KEY}) || chr(10) || chr(10) || 'Needs' || chr(10) || chr(10) || 'SQL' description_text, cast(({_KEY}) % 1000 as double) salary_min, 'EUR' salary_currency, strftime(epoch_ms(({_KEY}) * 1000000), '%Y-%m-%d %H:%M:%S') updated, 'full_text' text_quality from lineitem", model=False)
def n1_normalize_lever(spark, d):
    k = F.col("k")
    lists = F.array(F.struct(F.lit("Needs").alias("text"), F.lit(" SQL ").alias("content")))
    body = F.struct(k.alias("id"), F.concat(F.lit("Role "), S("k")).alias("text"), F.concat(F.lit("https://j.test/"), S("k")).alias("hostedUrl"), F.struct(F.lit(" Oslo").alias("location")).alias("categories"), F.concat(F.lit("About "), S("k")).alias("descriptionPlain"), lists.alias("lists"), F.struct((k % 1000).alias("min"), F.lit("EUR").alias("currency")).alias("salaryRange"), (k * 1_000_000).alias("createdAt"))
    out = normalize.normalize_lever(_postings(_lines(spark, d), body, F.lit("Acme").alias("company_name"), F.lit("site").alias("board_token_or_site")))
    return out.select("source_job_id", "company_name", "title", F.col("canonical_url").alias("url"), "location", "description_text", "salary_min", "salary_currency", F.date_format("source_updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), "text_quality")


@query(f"select distinct 'board:' || ({_KEY}) source_job_id, case when ({_KEY}) % 2 = 0 then 'Rome' else 'Bonn' end as location, 'Text ' || ({_KEY}) || ' & so on' description_text, cast(case when ({_KEY}) % 2 = 0 then 100 else 7 end as double) salary_min, cast(case when ({_KEY}) % 2 = 0 then 200 end as double) salary_max, case when ({_KEY}) % 2 = 0 then 'yearly' else 'hourly' end salary_interval from lineitem", model=False)
def n2_normalize_greenhouse(spark, d):
    """Pay ranges in even postings, a compensation in odd ones; a location that is an object or text."""
    k = F.col("k")
    page = F.concat(F.lit("<p>Text "), S("k"), F.lit("</p> &amp; so on"))
    even = F.to_json(F.struct(k.alias("id"), page.alias("content"), F.struct(F.lit("Rome ").alias("name")).alias("location"), F.array(F.struct(F.lit(100).alias("min_value"), F.lit(200).alias("maxValue"), F.lit("annual").alias("unit"))).alias("pay_input_ranges")))
    odd = F.to_json(F.struct(k.alias("id"), page.alias("content"), F.lit("Bonn").alias("location"), F.struct(F.lit("7").alias("min"), F.lit("Hour").alias("period")).alias("compensation")))
    rows = _lines(spark, d).select(F.when(k % 2 == 0, even).otherwise(odd).alias("posting"), F.lit("Acme").alias("company_name"), F.lit("board").alias("board_token_or_site"))
    return normalize.normalize_greenhouse(rows).select("source_job_id", "location", "description_text", "salary_min", "salary_max", "salary_interval")


@query(f"select distinct cast({_KEY} as varchar) source_job_id, case when ({_KEY}) % 2 = 0 then 'Firm ' || (({_KEY}) % 7) else 'Unknown company' end company_name, 'Untitled role' title, cast(({_KEY}) % 100 as double) salary_max, 'snippet' text_quality, '2024-03-01 10:00' updated from lineitem", model=False)
def n3_normalize_adzuna(spark, d):
    k = F.col("k")
    body = F.struct(k.alias("id"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("Firm "), (k % 7).cast("string"))).alias("display_name")).alias("company"), (k % 100).alias("salary_max"), F.lit("2024-03-01T10:00:00Z").alias("created"))
    out = normalize.normalize_adzuna(_postings(_lines(spark, d), body))
    return out.select("source_job_id", "company_name", "title", "salary_max", F.coalesce("text_quality", F.get_json_object("raw_payload", "$.text_quality")).alias("text_quality"), F.date_format("source_updated_at", "yyyy-MM-dd HH:mm").alias("updated"))


@query(f"select distinct cast({_KEY} as varchar) source_job_id, 'https://www.jobstreet.com.sg/job/' || ({_KEY}) url, 'Central, East' as location, cast((({_KEY}) % 9 + 1) * 1000 as double) salary_min, cast((({_KEY}) % 9 + 2) * 1000 as double) salary_max, 'SGD' salary_currency, 'monthly' salary_interval, case when ({_KEY}) % 2 = 0 then 'full_text' else 'snippet' end text_quality, case when ({_KEY}) % 2 = 0 then 'Body ' || ({_KEY}) || ' Short one two' else 'Short one two' end description_text from lineitem", model=False)
def n5_normalize_jobstreet(spark, d):
    k = F.col("k")
    pay = F.concat(F.lit("$"), (k % 9 + 1).cast("string"), F.lit(",000 - $"), (k % 9 + 2).cast("string"), F.lit(",000 per month"))
    body = F.struct(k.alias("jobId"), F.concat(F.lit("/job/"), S("k")).alias("jobUrl"), F.array(F.struct(F.lit("Central").alias("label")), F.struct(F.lit(" East").alias("label"))).alias("locations"), pay.alias("salaryLabel"), F.when(k % 2 == 0, F.concat(F.lit("<b>Body "), S("k"), F.lit("</b>"))).alias("description"), F.lit("Short").alias("teaser"), F.array(F.lit("one"), F.lit("two")).alias("bulletPoints"))
    out = normalize.normalize_jobstreet(_postings(_lines(spark, d), body))
    return out.select("source_job_id", F.col("canonical_url").alias("url"), "location", "salary_min", "salary_max", "salary_currency", "salary_interval", "text_quality", "description_text")


@query(f"select source, case when source in ('lever', 'greenhouse') then 'Acme ' || source else 'Unknown company' end company_name, count(*) postings, 'data jobs' ingest_query, 'robotics' family, 'data jobs' payload_query from (select distinct ['lever', 'greenhouse', 'adzuna', 'careers_gov', 'jobstreet'][({_KEY}) % 5 + 1] as source, {_KEY} k from lineitem) group by 1", model=False)
def n6_normalize_and_stamp(spark, d):
    """N6 normalize_postings over all five shapes at once, then N7 stamp_ingestion_metadata."""
    k = F.col("k")
    source = pick(k % 5, *normalize.SOURCES)
    board = F.when(source.isin(*normalize.BOARDS), "site")
    raw = _lines(spark, d).select(source.alias("source_name"), board.alias("board_token_or_site"), F.to_json(F.struct(k.alias("id"), F.concat(F.lit("Role "), S("k")).alias("title"))).alias("posting"))
    targets = spark.createDataFrame([(s, "site", f"Acme {s}") for s in normalize.BOARDS] + [("lever", "elsewhere", "Other")], "source string, board_token_or_site string, company_name string")
    out = normalize.stamp_metadata(normalize.normalize_postings(raw, targets), " Data  JOBS ", "robotics")
    return out.groupBy("source", "company_name", "ingest_query", F.col("ingest_role_family_id").alias("family"), F.get_json_object("raw_payload", "$.query").alias("payload_query")).agg(F.count("*").alias("postings"))


# taxonomies and runs

_SKILLS = "id long, name string, normalized_name string, category string, source_taxonomy string, taxonomy_version string, source_updated_at timestamp"
_ALIASES = "id long, skill_id long, alias string, normalized_alias string, match_type string, case_sensitive boolean"


@query("with r as (select lower(p_type) s, lower(case when p_partkey % 2 = 0 then p_brand else p_type end) a from part where p_partkey % 10 <> 0) select (select count(*) from r) rows, (select count(distinct s) from r) skills, (select count(*) from (select distinct s, a from r)) aliases, (select count(distinct s) from r) skill_rows, (select count(*) from (select distinct s, a from r)) alias_rows", model=False)
def i14_load_taxonomy_seed(spark, d):
    """A seed file loaded into empty tables, and once more into the result: nothing is added."""
    records, _ = readers.read_taxonomy_csv(spark, _seed(spark, d))
    s, a, _ = matching.load_taxonomy(spark.createDataFrame([], _SKILLS), spark.createDataFrame([], _ALIASES), records)
    s, a, counts = matching.load_taxonomy(s, a, records)
    return counts.crossJoin(s.agg(F.count("*").alias("skill_rows"))).crossJoin(a.agg(F.count("*").alias("alias_rows")))  # one row each


@query(_TAXONOMY + ", sizes as (select (select count(distinct s_name) from supplier) n, (select count(*) from items) a) select 'local' source_taxonomy, (select count(distinct l_partkey % 40) from lineitem) skills, cast(0 as bigint) aliases, cast(null as varchar) taxonomy_version union all select 'ssg_wsg', n, a, (select arg_max(['', 'v7', 'v8'][s_nationkey % 3 + 1], s_nationkey::varchar) from supplier where s_nationkey % 3 <> 0) from sizes", model=False)
def i15_sync_taxonomy(spark, d):
    """Responses synced beside the local taxonomy, which stays as it is."""
    old = A.skills(spark, d).withColumns({"taxonomy_version": F.lit(None).cast("string"), "source_updated_at": F.lit(None).cast("timestamp")})
    records = readers.read_taxonomy_json(spark, _responses(spark, d))
    return matching.sync_taxonomy(old, spark.createDataFrame([], _ALIASES), records)[2].select("source_taxonomy", "skills", "aliases", "taxonomy_version")


@query(_BATCH + """ select (select count(distinct cid) from batch) companies, (select count(distinct job_id) from batch) jobs, (select count(*) from batch) listings, (select count(*) from batch) observations,
  (select count(distinct job_id) from batch where text_quality = 'full_text') job_skills, cast(0 as bigint) closed, 'completed_with_errors' status, (select count(*) from batch) summary_listings""")
def i17_ingest(spark, d):
    """A whole run into empty tables: every listing is a posting, two targets, one of which failed."""
    t = A.tables(spark, d)
    empty = lambda df, **more: df.limit(0).withColumns({k: F.lit(None).cast(v) for k, v in more.items()})
    observations = spark.createDataFrame([], "id long, source_listing_id long, ingestion_run_id string, observed_at timestamp, is_active boolean, source_updated_at timestamp, content_hash string, raw_payload string")
    job_skills = spark.createDataFrame([], "job_id long, skill_id long, extraction_method string, confidence double, matched_text string")
    candidates = spark.createDataFrame([], "job_id long, candidate_job_id long, match_type string, score double, reason string, status string, created_at timestamp")
    start = t.with_(companies=empty(t.companies), jobs=empty(t.jobs, job_key="string"), listings=empty(t.listings.drop("ingestion_run_id"), ingest_query="string", ingestion_run_id="string"), observations=observations, job_skills=job_skills)
    targets = spark.createDataFrame([("run", "adzuna", "data", None), ("run", "lever", None, "no answer")], "run_id string, source string, ingest_query string, error string")
    batch = _batch(spark, d).drop("job_id")
    out = ingest.ingest(start, A.aliases(spark, [(1, 1, "large tables", False), (2, 2, "Fortran", False)]), candidates, batch, targets, AS_OF)
    sizes = [out[n].agg(F.count("*").alias(n)) for n in ("companies", "jobs", "listings", "observations", "job_skills")] + [out["jobs"].agg(F.count("closed_at").alias("closed"))]
    one = sizes[0]
    for s in sizes[1:]:
        one = one.crossJoin(s)  # one row each
    return one.crossJoin(out["summary"].select("status", F.col("listings").alias("summary_listings")))


@query("""select 'https://example.test/jobs/' || id as canonical_url, seen or (closed_at is null and not asked) as is_open, seen and closed_at is not null as reopened, not seen and asked and closed_at is null as closed_now
 from (select j.*, coalesce(bool_or(l.source_company_name is not null), false) seen, coalesce(bool_or(l.source in ('adzuna', 'jobstreet')), false) asked from jobs j left join listings l on l.job_id = j.id group by all)""".replace("group by all)", "group by j.id, j.company_id, j.title, j.ntitle, j.rf, j.fid, j.flabel, j.location, j.content_hash, j.first_seen_at, j.last_seen_at, j.closed_at)"))
def i17_ingest_next_run(spark, d):
    """A run over existing tables: all listings are known and were missed twice; the run finds those that name a company, and its two queries miss their others."""
    t = A.tables(spark, d)
    key, identity = F.concat(F.lit("url:"), "canonical_url"), F.xxhash64("source", "source_job_id")
    jobs = t.jobs.withColumn("job_key", key).withColumn("id", F.xxhash64("job_key"))
    listings = t.listings.drop("ingestion_run_id").withColumns({"id": identity, "job_id": F.xxhash64(key), "ingest_query": F.lit("data"), "ingestion_run_id": F.lit("before")})
    missed = listings.select("id", F.explode(F.array(*[F.lit(AS_OF - timedelta(days=n)) for n in (2, 1)])).alias("observed_at"))
    none = F.lit(None).cast("string")
    log = missed.select(F.xxhash64("id", "observed_at").alias("id"), F.col("id").alias("source_listing_id"), F.lit("before").alias("ingestion_run_id"), "observed_at", F.lit(False).alias("is_active"), F.lit(None).cast("timestamp").alias("source_updated_at"), none.alias("content_hash"), none.alias("raw_payload"))
    job_skills = spark.createDataFrame([], "job_id long, skill_id long, extraction_method string, confidence double, matched_text string")
    candidates = spark.createDataFrame([], "job_id long, candidate_job_id long, match_type string, score double, reason string, status string, created_at timestamp")
    named = t.listings.where("source_company_name is not null").select("source", "source_job_id")
    batch = _batch(spark, d).drop("job_id").join(named, ["source", "source_job_id"], "left_semi")
    targets = spark.createDataFrame([("run", s, "data", None) for s in ("adzuna", "jobstreet")], "run_id string, source string, ingest_query string, error string")
    out = ingest.ingest(t.with_(jobs=jobs, listings=listings, observations=log, job_skills=job_skills), A.aliases(spark, [(1, 1, "Fortran", False)]), candidates, batch, targets, AS_OF)
    before = jobs.select("canonical_url", F.col("closed_at").isNotNull().alias("was"))
    now = F.col("closed_at").isNull()
    return out["jobs"].join(before, "canonical_url").select("canonical_url", now.alias("is_open"), (now & F.col("was")).alias("reopened"), (~now & ~F.col("was")).alias("closed_now"))


# duplicates and archive

_BEST = """ , best as (select x, y, max({'score': score, 'type': kind, 'reason': 'same normalized company, title, location, and ' || why || ' across distinct sources'}) m from (
  select *, case when n >= 2 then 'structured_fields' else 'structured_fields_salary' end kind, case when n >= 2 and sal then 0.9 when n >= 2 then 0.88 when n = 1 and sal then 0.86 end score,
    concat_ws('; ', case when r then 'matching responsibilities' end, case when q then 'matching required competencies' end, case when sal then 'matching salary range' end, case when r and q then 'matching normalized description' end) why
  from (select x, y, a.resp = b.resp r, a.req = b.req q, (a.resp = b.resp)::int + (a.req = b.req)::int n,
    (a.salary_min is not null or a.salary_max is not null) and (b.salary_min is not null or b.salary_max is not null) and a.salary_min is not distinct from b.salary_min and a.salary_max is not distinct from b.salary_max and a.salary_currency = b.salary_currency and (a.salary_interval is null or b.salary_interval is null or lower(a.salary_interval) = lower(b.salary_interval)) sal
    from cand join listings a on a.job_id = x join listings b on b.job_id = y and a.source <> b.source where not hs)) where score is not null group by 1, 2)
"""


@query(_PAIRS + _BEST + "select x job_id, y candidate_job_id, m.type match_type, m.reason reason from best union all select x, y, 'content_hash', 'same normalized company, title, location, and content hash' from cand where hs")
def x3_match_evidence(spark, d):
    """What each pair rests on, in words."""
    t = A.tables(spark, d)
    return dedupe.candidate_pairs(t.jobs, t.listings).select("job_id", "candidate_job_id", "match_type", "reason")


@query("select id, job_id, source, salary_min from listings")
def y2_restore_listings(spark, d):
    """Listings as they are after all second and third listings were archived and restored."""
    t = A.tables(spark, d)
    ids = t.listings.where("id % 10 in (2, 3)").select("id")
    gone = archive.archive_listings(t.listings, t.observations, t.jobs, t.job_skills, spark.createDataFrame([], "job_id long, candidate_job_id long, status string"), ids, AS_OF)
    return archive.restore_listings(gone, ids).listings.select("id", "job_id", "source", "salary_min")


@query("select lid source_listing_id, strftime(ts, '%Y-%m-%d') as observed, act as is_active, count(*) as n from obs group by 1, 2, 3")
def y2_restore_observations(spark, d):
    """The observation log after every listing was archived, its last ones with their jobs, and restored."""
    t = A.tables(spark, d)
    ids = t.listings.select("id")
    gone = archive.archive_listings(t.listings, t.observations, t.jobs, t.job_skills, spark.createDataFrame([], "job_id long, candidate_job_id long, status string"), ids, AS_OF)
    back = archive.restore_listings(gone, ids).observations
    return back.groupBy("source_listing_id", F.date_format("observed_at", "yyyy-MM-dd").alias("observed"), "is_active").agg(F.count("*").alias("n"))


@query("select id source_listing_id from listings where id % 5 < 3")
def y3_purge_archive(spark, d):
    """All listings archived, id % 5 days ago: those of two days and less stay."""
    t = A.tables(spark, d)
    gone = archive.archive_listings(t.listings, t.observations, t.jobs, t.job_skills, spark.createDataFrame([], "job_id long, candidate_job_id long, status string"), t.listings.select("id"), AS_OF)
    aged = gone.archive.withColumn("deleted_at", F.timestamp_add("DAY", (-(F.col("source_listing_id") % 5)).cast("int"), F.lit(AS_OF)))
    return archive.purge_archive(aged, AS_OF).select("source_listing_id")


# report bundles

_VIEW = " select company, job_count, listing_count, case when job_count = 0 then 'no_jobs' when listing_count = 0 then 'no_listings' else 'healthy' end health, latest_seen = max(latest_seen) over () is_newest from ({}) where contains(lower(company), 'customer#') and (top_sources like '%lever:%')"


@query(_COMPANIES.replace(" select company, count(*) job_count", _VIEW.split("{}")[0] + " select company, count(*) job_count", 1) + _VIEW.split("{}")[1])
def o6_company_filter(spark, d):
    from hirelens.operators import roles_report

    t = A.tables(spark, d)
    rows = roles_report.top_hiring_companies(t, active.active_listings(t, AS_OF), AS_OF, limit=None)
    return overview.company_filter_view(rows, "Customer#", "lever").select("company", "job_count", "listing_count", "health", "is_newest")


def _bundle(frames: dict[str, DataFrame], **columns: tuple[str, str]) -> DataFrame:
    """(part, key, value) of some frames of a report: for each its key column and its number."""
    return readers.union_all([frames[part].select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.round(F.col(value).cast("double"), 4).alias("value")) for part, (key, value) in columns.items()])


@query(f"""select 'top_skills' part, skill as key, cast(n as double) as value from (select skill, count(distinct job_id) n from js join open_jobs j on j.id = job_id group by 1 order by 2 desc, 1 limit 10)
  union all select 'skill_coverage', source, count(*)::double from active group by 2
  union all select 'salary_by_source', segment, average from (select source segment, {_SEGMENT} from facts where annual is not null group by 1)
  union all select 'top_salary_listings', cast(id as varchar), round(annual, 4) from (select id, annual from facts where annual is not null order by annual desc, id limit 10)""")
def o9_snapshot_report(spark, d):
    return _bundle(overview.snapshot_report(A.tables(spark, d), AS_OF), top_skills=("skill", "job_count"), skill_coverage=("source", "total"), salary_by_source=("segment", "average"), top_salary_listings=("listing_id", "annualized"))


@query(_WEEKS + """select 'skill_demand' part, strftime(week, '%Y-%m-%d') as key, cast(job_count as double) as value from lagged where skill = 'skill_7'
  union all select 'posting_velocity', strftime(week, '%Y-%m-%d'), (select count(*) from jobs where cast(date_trunc('week', first_seen_at) as date) = week)::double from spine
  union all select 'time_to_close', count(*)::varchar, round(quantile_cont(epoch(closed_at - first_seen_at) / 86400, 0.5), 4) from jobs where closed_at is not null
  union all select 'role_families', fid, n::double from (select fid, any_value(flabel) fl, count(*) n, (select count(*) from facts f where f.fid = j.fid) m from open_jobs j group by 1 order by fid = 'other', n desc, m desc, fl limit 10)""")
def o10_trend_report(spark, d):
    out = overview.trend_report(A.tables(spark, d), AS_OF, WEEKS, "skill_7")
    out["skill_demand"], out["posting_velocity"] = (out[c].withColumn("week", day("week")) for c in ("skill_demand", "posting_velocity"))
    rows = _bundle(out, skill_demand=("week", "job_count"), posting_velocity=("week", "new_jobs"), time_to_close=("closed_count", "median_days"), role_families=("family_id", "job_count"))
    return rows


@query("""select 'summary' part, count(*)::varchar as key, count(distinct company)::double as value from facts
  union all select 'companies', company, n::double from (select company, count(*) n, count(*) filter (first_seen_at >= timestamp '2001-08-01' - interval 7 day) w, count(distinct flabel) l from facts group by 1 order by company = 'UNKNOWN', 2 desc, 3 desc, 4 desc, 1 limit 10)
  union all select 'breadth', company, n::double from (select company, count(distinct fid) n, count(*) m from facts group by 1 order by company = 'UNKNOWN', 2 desc, 3 desc, 1 limit 10)""")
def o11_demand_report(spark, d):
    return _bundle(overview.demand_report(A.tables(spark, d), AS_OF), summary=("active_listings", "companies"), companies=("company", "active"), breadth=("company", "families"))
