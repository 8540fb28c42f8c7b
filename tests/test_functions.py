from datetime import datetime

from pyspark.sql import functions as F

from hirelens.functions import html, roles, sections, text


def one(spark, column, **values):
    types = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    row = tuple(values.values()) or (None,)
    return spark.createDataFrame([row], types).select(column.alias("r")).first()["r"]


def test_clean_and_normalize(spark):
    assert one(spark, text.clean("a"), a="  Big  Data ") == "Big  Data"
    assert one(spark, text.normalize_text("a"), a=" Big \n DATA x ") == "big data x"
    assert one(spark, text.normalize_query("a"), a="  ") is None
    assert one(spark, text.substantive_text("a"), a="short") is None
    assert one(spark, text.content_hash("a"), a="") is None


def test_numbers_and_times(spark):
    assert one(spark, text.to_float("a"), a="12.5") == 12.5
    assert one(spark, text.to_float("a"), a="n/a") is None
    assert one(spark, text.parse_iso("a"), a="2024-03-01T10:00:00Z") == datetime(2024, 3, 1, 10)
    assert one(spark, text.parse_iso("a"), a="2024-03-01T10:00:00+08:00") == datetime(2024, 3, 1, 2)
    assert one(spark, text.parse_iso("a"), a="soon") is None
    assert one(spark, text.epoch_ms("a"), a="1700000000000") == datetime(2023, 11, 14, 22, 13, 20)
    assert one(spark, text.week_start(F.lit(datetime(2024, 3, 3)))).isoformat() == "2024-02-26"


def test_salary(spark):
    assert one(spark, text.salary_numbers("a"), a="$4,500 - $6,000.50 per month") == [4500.0, 6000.5]
    assert one(spark, text.interval_from_label("a"), a="per annum") == "yearly"
    assert [one(spark, text.normalize_interval("a"), a=x) for x in ("Yr", "MO", "hourly rate", "fortnight")] == ["yearly", "monthly", "hourly", "fortnight"]
    assert one(spark, text.annualized_midpoint("a", "b", "c"), a=6000.0, b=8000.0, c="Monthly") == 84000.0
    assert one(spark, text.annualized_midpoint("a", "b", "c"), a=6000.0, b=8000.0, c="sprint") is None
    assert one(spark, text.loose_midpoint("a", F.lit(None).cast("double")), a=5.0) == 5.0
    assert one(spark, text.closed_midpoint("a", F.lit(None).cast("double")), a=5.0) is None
    frame = spark.createDataFrame([(7.0,), (14.0,), (28.0,), (42.0,)], "d double")
    assert frame.agg(text.linear_percentile("d", 0.5, 0.75)).first()[0] == [21.0, 31.5]


def test_urls_and_lists(spark):
    base = "https://boards.test/"
    assert [one(spark, text.resolve_url(base, "a"), a=x) for x in ("/job/1", "job/1", "https://x.test/y", "//c.test/z")] == ["https://boards.test/job/1", "https://boards.test/job/1", "https://x.test/y", "https://c.test/z"]
    assert one(spark, text.split_values("a"), a="x; y;; z") == ["x", "y", "z"]
    assert one(spark, text.distinct_by_key(text.split_values("a")), a="Go, go ,SQL") == ["Go", "SQL"]


def test_roles(spark):
    family = lambda title: one(spark, roles.classify_title("a")["id"], a=title)
    assert family("Senior GenAI / LLM Engineer") == "ai_ml_engineer"
    assert family("Senior Robotics Software Engineer") == "robotics"
    assert family("Pastry chef") == "other"
    assert one(spark, roles.custom_family_id("a"), a="AI Platform!") == "custom:ai_platform"
    assert one(spark, roles.custom_family_id("a"), a=" !! ") is None
    assert one(spark, roles.custom_family_label("a"), a="custom:ai_platform") == "AI Platform"
    assert one(spark, roles.custom_family_label("a"), a="custom:Bad Slug") is None
    assert one(spark, roles.resolve_family("a", "b")["confidence"], a="robotics", b="Chef") == 1.0
    assert one(spark, roles.resolve_family("a", "b")["id"], a="nonsense", b="Data Analyst") == "data_analyst"


def test_sections(spark):
    body = "About us. Key responsibilities: build pipelines. Preferred requirements - Spark. Good to have: Kafka."
    assert one(spark, sections.extract_sections("a"), a=body) == {"responsibilities": "build pipelines.", "required_competencies_and_certifications": "Spark.", "preferred_competencies_and_qualifications": "Kafka."}
    assert one(spark, sections.extract_sections("a"), a="Requirements: one. Requirements: two.") == {"required_competencies_and_certifications": "two."}
    assert one(spark, sections.extract_sections("a"), a="no heading, irresponsibilities") == {}
    assert one(spark, sections.sections_of_listing("p", "a"), p='{"structured_sections":{"k":"v","n":null}}', a=body) == {"k": "v"}


def test_html(spark):
    assert one(spark, html.html_to_text("a"), a="<p>A &amp; B</p> <script>var x</script><b> c </b>") == "A & B var x c"
    assert one(spark, html.html_to_text("a"), a="") is None
    assert one(spark, html.sanitize_text("a"), a="<p>A &lt;b&gt;</p>\n x") == "A <b> x"
