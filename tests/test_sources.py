import json
from datetime import datetime

from pyspark.sql import functions as F

from hirelens.sources import normalize, readers, sinks


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def test_targets(spark, tmp_path):
    path = write(tmp_path / "t.csv", "company_name,source,board_token_or_site,enabled,notes\n Acme ,lever,acme,yes, \nOff,lever,off,No,x\nBeta,greenhouse,beta,,n\n")
    rows = readers.read_targets(spark, path).collect()
    assert [(r["company_name"], r["notes"]) for r in rows] == [("Acme", None), ("Beta", "n")]
    assert readers.read_targets(spark, path, "lever").count() == 1


def test_taxonomy_csv(spark, tmp_path):
    path = write(tmp_path / "s.csv", "skill_name,category,source_taxonomy,alias,match_type,case_sensitive\nPython,lang,,,,\nGo,lang,local,Golang,literal,Yes\n,x,,,,\n")
    records, rejects = readers.read_taxonomy_csv(spark, path)
    assert [(r["skill_name"], r["alias"], r["source_taxonomy"], r["match_type"], r["case_sensitive"]) for r in records.collect()] == [("Python", "Python", "local", "literal", False), ("Go", "Golang", "local", "literal", True)]
    assert rejects.count() == 1


def test_taxonomy_json(spark, tmp_path):
    payload = {"version": "v9", "lastUpdated": "2024-05-01", "data": {"skills": [{"skillName": "Data Mining", "skill_category": "Data", "aliases": ["mining", "Data mining"]}, {"name": "SQL", "synonyms": "Structured Query; sql", "updatedAt": "2024-06-01T00:00:00Z"}]}}
    rows = readers.read_taxonomy_json(spark, write(tmp_path / "x.json", payload)).collect()
    assert [(r["skill_name"], r["alias"]) for r in rows] == [("Data Mining", "Data Mining"), ("Data Mining", "mining"), ("SQL", "SQL"), ("SQL", "Structured Query")]
    assert {r["taxonomy_version"] for r in rows} == {"v9"}
    assert rows[-1]["source_updated_at"] == datetime(2024, 6, 1)


def test_envelopes(spark, tmp_path):
    good = write(tmp_path / "a.json", {"data": {"jobCards": [{"id": 1}, {"id": 2}]}})
    rows, _ = readers.read_raw_postings(spark, good, "jobstreet")
    assert [json.loads(r["posting"])["id"] for r in rows.orderBy("page_pos").collect()] == [1, 2]
    bad = write(tmp_path / "b.json", {"oops": []})
    rows, rejects = readers.read_raw_postings(spark, bad, "lever", strict=False)
    assert rows.count() == 0 and rejects.count() == 1
    assert readers.read_raw_postings(spark, write(tmp_path / "c.json", {"results": []}), "adzuna")[0].count() == 0


def frame(spark, posting, **more):
    names = ", ".join(["posting string", *[f"{k} string" for k in more]])
    return spark.createDataFrame([(json.dumps(posting), *more.values())], names)


def test_lever(spark):
    posting = {"id": "x1", "text": "Data Engineer", "hostedUrl": "https://l.test/x1", "createdAt": 1700000000000, "categories": {"location": "Here", "commitment": "Full-time"}, "descriptionPlain": "Intro", "lists": [{"text": "Do", "content": "things"}], "salaryRange": {"min": 1000, "max": 2000, "currency": "SGD", "interval": "per-month"}}
    r = normalize.normalize_lever(frame(spark, posting, company_name="Acme", board_token_or_site="acme")).first()
    assert (r["source_job_id"], r["title"], r["location"], r["description_text"], r["salary_min"], r["salary_interval"]) == ("acme:x1", "Data Engineer", "Here", "Intro\n\nDo\n\nthings", 1000.0, "per-month")
    assert r["source_updated_at"] == datetime(2023, 11, 14, 22, 13, 20)


def test_greenhouse(spark):
    posting = {"id": 7, "title": "", "absolute_url": "https://g.test/7", "location": {"name": "There"}, "content": "<p>Hi</p>", "pay_input_ranges": [{"min_value": 0, "min": 5, "max_value": 9, "unit": "YR", "currency_code": "USD"}]}
    r = normalize.normalize_greenhouse(frame(spark, posting, company_name="Beta", board_token_or_site="b")).first()
    assert (r["source_job_id"], r["title"], r["location"], r["description_text"], r["salary_min"], r["salary_max"], r["salary_currency"], r["salary_interval"]) == ("b:7", "Untitled role", "There", "Hi", 5.0, 9.0, "USD", "yearly")


def test_adzuna(spark):
    r = normalize.normalize_adzuna(frame(spark, {"id": "9", "title": "T", "company": {"display_name": "C"}, "description": "d", "salary_min": 10})).first()
    assert (r["company_name"], r["text_quality"], r["salary_min"], r["salary_interval"]) == ("C", "snippet", 10.0, None)
    assert json.loads(r["raw_payload"])["text_quality"] == "snippet"


def test_careers_gov(spark):
    posting = {"uuid": "u1", "title": "T", "description": "<p>Requirements: ten years of work</p>", "postedCompany": {"name": "Gov"}, "salary": {"minimum": 0, "maximum": 5}, "employmentTypes": [{"employmentType": "Full"}, {"employmentType": "Perm"}], "metadata": {"updatedAt": "2024-01-02T00:00:00Z"}}
    r = normalize.normalize_careers_gov(frame(spark, posting)).first()
    assert (r["location"], r["salary_currency"], r["salary_min"], r["workplace_type"]) == ("Singapore", "SGD", 0.0, "Full; Perm")
    assert json.loads(r["raw_payload"])["structured_sections"] == {"required_competencies_and_certifications": "ten years of work"}


def test_jobstreet(spark):
    posting = {"jobId": 5, "title": "T", "jobUrl": "/job/5", "companyName": "J", "locations": [{"label": "A"}, {"name": "B"}], "workTypes": ["Full", {"label": "Temp"}], "teaser": "tease", "bulletPoints": ["one", " "], "salaryLabel": "$3,000 – $4,000 monthly"}
    r = normalize.normalize_jobstreet(frame(spark, posting)).first()
    assert (r["source_job_id"], r["canonical_url"], r["location"], r["workplace_type"], r["description_text"]) == ("5", "https://www.jobstreet.com.sg/job/5", "A, B", "Full, Temp", "tease one")
    assert (r["salary_min"], r["salary_max"], r["salary_currency"], r["salary_interval"], r["text_quality"]) == (3000.0, 4000.0, "SGD", "monthly", "snippet")


def test_union_and_stamp(spark):
    raw = spark.createDataFrame([("lever", "acme", '{"id":"1","text":"A"}', 0), ("adzuna", None, '{"id":"2","title":"B"}', 1)], "source_name string, board_token_or_site string, posting string, batch_pos int")
    targets = spark.createDataFrame([("lever", "acme", "Acme")], "source string, board_token_or_site string, company_name string")
    rows = normalize.stamp_metadata(normalize.normalize_postings(raw, targets), " Data  X ", None).orderBy("batch_pos").collect()
    assert [(r["source"], r["company_name"], r["ingest_query"]) for r in rows] == [("lever", "Acme", "data x"), ("adzuna", "Unknown company", "data x")]
    assert json.loads(rows[0]["raw_payload"])["query"] == "data x"


def test_write_table_replaces_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "x int, w string"), path, "w")
    sinks.write_table(spark.createDataFrame([(3, "b")], "x int, w string"), path, "w")
    assert sorted(spark.read.parquet(path).select(F.col("x")).toPandas()["x"]) == [1, 3]


def test_payload_is_parsed_once(spark, monkeypatch):
    """Fields read from one parse equal those read path by path, on awkward payloads of all sources; the plan has one parse."""
    odd = [
        '{"id": 5, "text": "T", "title": "Engineer", "uuid": "u", "salary": {"min": 0, "max": "12.50", "minimum": 3000, "type": {"salaryType": "Monthly"}}, "createdAt": 1700000000000, "updatedAt": "2024-01-02T03:04:05Z"}',
        '{"id": "a", "id": "b", "title": "Twice"}', "not json", "{}", "[]", '{"id": 7.25, "location": {"name": " Here "}, "lists": [{"text": "H", "content": "<b>x</b>"}], "pay_input_ranges": [{"min_value": 1000, "max_value": 2000.5, "unit": "year"}]}',
        '{"id": null, "title": "", "company": {"display_name": "C"}, "salary_min": 100.5, "locations": ["A", {"label": "B"}], "workTypes": "full", "bulletPoints": ["p", "q"], "salaryLabel": "$3,000 - $4,500 per month"}',
        '{"jobId": "j", "jobUrl": "/job/1", "title": "x\\u00e9\\n y", "employmentTypes": [{"employmentType": "Full Time"}], "metadata": {"jobPostId": "m"}, "_links": {"self": {"href": "h"}}, "content": "<p>a &amp; b</p>", "listingDate": "2024-05-05"}', None,
    ]
    frame = spark.createDataFrame([(x, "Acme", "acme") for x in odd], "posting string, company_name string, board_token_or_site string")
    makers = [getattr(normalize, f"normalize_{s}") for s in normalize.SOURCES]
    once = [make(frame) for make in makers]
    for df in once:
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("parse_json(") + plan.count("parsejson") == 1
    got = [sorted(map(str, df.collect())) for df in once]
    monkeypatch.setattr(normalize, "at", lambda path, of="posting": F.get_json_object(of, f"$.{path}"))
    assert got == [sorted(map(str, make(frame).collect())) for make in makers]
