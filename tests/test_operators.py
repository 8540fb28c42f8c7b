from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirelens.operators import active, archive, dedupe, demand, ingest, matching, overview, roles_report, salary, skills, trends
from hirelens.plans import adapters
from hirelens.schemas import SCHEMAS, Tables

NOW = datetime(2024, 3, 6, 12)


def table(spark, name, rows):
    """Rows as dicts; columns that are not named are null."""
    schema = SCHEMAS[name]
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def listing(i, job, source="lever", **more):
    return {"id": i, "job_id": job, "source": source, "source_job_id": str(i), "first_seen_at": NOW, "last_seen_at": NOW, "text_quality": "full_text", **more}


def model(spark, jobs, listings, observations=(), skill_rows=(), companies=({"id": 1, "name": "Alpha"}, {"id": 2, "name": "Beta"})):
    base = [{"first_seen_at": NOW, "last_seen_at": NOW, "normalized_title": j.get("title", "").lower(), **j} for j in jobs]
    names = sorted({s for _, s in skill_rows})
    return Tables(
        table(spark, "companies", companies), table(spark, "jobs", base), table(spark, "source_listings", listings),
        table(spark, "posting_observations", [{"id": k, **o} for k, o in enumerate(observations)]),
        table(spark, "skills", [{"id": k, "name": s, "normalized_name": s.lower()} for k, s in enumerate(names)]),
        table(spark, "job_skills", [{"job_id": j, "skill_id": names.index(s), "extraction_method": "alias:literal", "confidence": 1.0} for j, s in skill_rows]),
    )


def test_active_listings(spark):
    seen = [{"source_listing_id": 1, "observed_at": NOW, "is_active": True}, {"source_listing_id": 1, "observed_at": NOW + timedelta(hours=1), "is_active": False}, {"source_listing_id": 2, "observed_at": NOW, "is_active": False}, {"source_listing_id": 2, "observed_at": NOW, "is_active": True}]
    t = model(spark, [{"id": 1, "title": "A"}, {"id": 2, "title": "B", "closed_at": NOW}], [listing(1, 1), listing(2, 1), listing(3, 1), listing(4, 2), listing(5, None)], seen)
    assert sorted(r["id"] for r in active.active_listings(t, NOW).collect()) == [2, 3]


def test_salary_ranges(spark):
    rows = [listing(1, 1, salary_min=6000.0, salary_max=8000.0, salary_currency="SGD", salary_interval="monthly"), listing(2, 1, salary_min=7000.0, salary_max=9000.0, salary_currency="SGD", salary_interval="monthly"), listing(3, 1, salary_min=5.0, salary_currency="USD")]
    t = model(spark, [{"id": 1, "title": "Data Engineer", "company_id": 1}], rows)
    facts = active.listing_facts(t, active.active_listings(t, NOW))
    sgd, usd = salary.salary_ranges(facts).collect()
    assert (sgd["posting_count"], sgd["salary_min"], sgd["salary_max"], sgd["average_annualized"], sgd["p25"], sgd["median"], sgd["p75"]) == (2, 6000.0, 9000.0, 90000.0, 87000.0, 90000.0, 93000.0)
    assert (usd["interval"], usd["closed_count"], usd["average_annualized"]) == ("unspecified", 0, None)
    assert salary.salary_by_company(facts).first()["segment"] == "Alpha"
    assert salary.salary_ranges(facts.limit(0)).count() == 0


def test_coverage_parts_make_the_whole(spark):
    t = adapters.tables(spark, "/root/testdata/sf0.001")
    rows = salary.salary_coverage(active.listing_facts(t, t.listings)).collect()
    whole = next(r for r in rows if r["all_sources"])
    assert whole["total"] == sum(r["total"] for r in rows if not r["all_sources"])


def test_skill_reports(spark):
    t = model(spark, [{"id": 1, "title": "Data Engineer", "company_id": 1}, {"id": 2, "title": "Analyst"}], [listing(1, 1), listing(2, 2, "adzuna", text_quality="snippet")], skill_rows=[(1, "SQL"), (1, "Python"), (2, "SQL")])
    assert [(r["skill"], r["job_count"]) for r in skills.top_skills(t, NOW).collect()] == [("SQL", 2), ("Python", 1)]
    assert skills.skills_by_company(t, NOW).collect()[-1]["company"] == "UNKNOWN"
    rows = skills.skills_by_role_keyword(t, NOW).collect()
    assert [r["keyword"] for r in rows] == ["data", "data", "engineer", "engineer", "analyst"]
    cover = {r["source"]: r for r in skills.skill_coverage(t, t.listings).collect()}
    assert cover["adzuna"]["full_text_rate"] == 0 and cover["lever"]["with_skills"] == 1


def test_roles_and_demand(spark):
    jobs = [{"id": 1, "title": "Data Engineer", "company_id": 1}, {"id": 2, "title": "Data Engineer"}, {"id": 3, "title": "Cook", "company_id": 2}]
    rows = [listing(1, 1, salary_min=8000.0, salary_max=8000.0, salary_interval="monthly"), listing(2, 2, "adzuna", source_company_name=" Gamma "), listing(3, 3, first_seen_at=NOW - timedelta(days=20))]
    t = model(spark, jobs, rows, skill_rows=[(1, "Python"), (2, "Python")])
    first, last = roles_report.role_family_summaries(t, t.listings, NOW).collect()
    assert (first["family_id"], first["job_count"], first["company_count"], first["average_annualized"], last["family_id"]) == ("data_engineer", 2, 2, 96000.0, "other")
    assert first["top_skills"][0]["count"] == 2
    assert roles_report.role_family_catalog(t, roles_report.role_family_summaries(t, t.listings, NOW, limit=None)).count() == 14
    assert {r["company"] for r in roles_report.top_hiring_companies(t, t.listings, NOW).collect()} == {"Alpha", "Gamma", "Beta"}
    facts = active.listing_facts(t, t.listings)
    summary = demand.active_summary(facts, NOW).first()
    assert (summary["active_listings"], summary["new_7_days"], summary["new_30_days"]) == (3, 2, 3)
    alpha = next(r for r in demand.company_signals(t, facts, NOW).collect() if r["company"] == "Alpha")
    assert (alpha["active"], alpha["disclosure_rate"], alpha["delta"]) == (1, 1.0, 1)
    view = overview.company_filter_view(roles_report.top_hiring_companies(t, t.listings, NOW), "a", "lever", "Data Engineer")
    assert [(r["company"], r["health"], r["is_newest"]) for r in view.collect()] == [("Alpha", "healthy", True)]


def test_trends(spark):
    week = timedelta(days=7)
    seen = [{"source_listing_id": 1, "observed_at": NOW - week, "is_active": True}, {"source_listing_id": 2, "observed_at": NOW, "is_active": True}]
    jobs = [{"id": 1, "title": "A", "first_seen_at": NOW - week, "closed_at": NOW}, {"id": 2, "title": "B"}]
    t = model(spark, jobs, [listing(1, 1), listing(2, 2, salary_min=6000.0, salary_max=8000.0, salary_interval="monthly")], seen, [(1, "SQL"), (2, "SQL")])
    assert [(r["job_count"], r["previous"], r["delta"], r["delta_percent"]) for r in trends.skill_demand(t, "sql", NOW, 2).orderBy("week").collect()] == [(1, None, None, None), (1, 1, 0, 0.0)]
    assert [(r["job_count"], r["average_annualized"]) for r in trends.salary_trend(t, NOW, 2).collect()] == [(0, None), (1, 84000.0)]
    assert [(r["new_jobs"], r["closed_jobs"]) for r in trends.posting_velocity(t, NOW, 2).collect()] == [(1, 0), (1, 1)]
    assert trends.time_to_close(t).first()["median_days"] == 7.0


def test_skill_matching(spark):
    aliases = [(1, 1, "Go", False), (2, 2, "C++", False), (3, 3, "C#", False), (4, 4, ".NET", False), (5, 5, "Node.js", False), (6, 6, "SQL Server", False), (7, 7, "R", True), (8, 1, "Golang", False), (9, 9, "++", False)]
    a = adapters.aliases(spark, aliases)
    texts = spark.createDataFrame([("x", "We use Go, C++, C#, .NET, node.js and SQL Server; also R."), ("y", "We go live soon with golang and r"), ("z", "Cargo"), ("n", None)], "key string, text string")
    found = {(r["key"], r["skill_id"]): r for r in matching.find_matches(texts, a).collect()}
    assert {s for k, s in found if k == "x"} == {1, 2, 3, 4, 5, 6, 7}
    assert {s for k, s in found if k == "y"} == {1} and found["y", 1]["alias_id"] == 8
    assert not [1 for k, _ in found if k == "z"]


def test_matches_of_many_aliases(spark, monkeypatch):
    """A table too large to be broadcast gives the same rows; aliases without a letter or digit are found too."""
    a = adapters.aliases(spark, [(1, 1, "SQL", False), (2, 1, "sql server", False), (3, 2, "数据", False), (4, 3, "Ñandú", False), (5, 4, "++", False), (6, 5, "ß", True)])
    texts = spark.createDataFrame([("x", "SQL Server and ++ marks"), ("y", "处理 数据 with ñANDÚ"), ("z", "nothing"), ("n", None)], "key string, text string")
    rows = lambda: sorted(map(tuple, matching.find_matches(texts, a).collect()))
    few = rows()
    monkeypatch.setattr(matching, "BROADCAST_ALIASES", 2)
    assert rows() == few and [(r[0], r[1], r[2]) for r in few] == [("x", 1, 1), ("x", 4, 5), ("y", 2, 3), ("y", 3, 4)]


def test_taxonomy_twice(spark):
    records = spark.createDataFrame([("SQL", "Data", "gov", "v1", None, "SQL", "literal", False, 1), ("SQL", None, "gov", None, None, "Structured", "literal", True, 2)], "skill_name string, category string, source_taxonomy string, taxonomy_version string, source_updated_at timestamp, alias string, match_type string, case_sensitive boolean, pos int")
    old = table(spark, "skills", [{"id": 5, "name": "sql", "normalized_name": "sql", "source_taxonomy": "local"}])
    s, a, counts = matching.load_taxonomy(old, table(spark, "skill_aliases", []), records)
    again, a2, _ = matching.load_taxonomy(s, a, records)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, s.collect()), key=str)
    assert (s.count(), a2.count(), counts.first()["rows"]) == (2, 2, 2)
    assert s.where("source_taxonomy = 'gov'").first()["category"] == "Data"


def batch(spark, rows, run="r1"):
    schema = "run_id string, batch_pos int, source string, source_job_id string, company_name string, title string, canonical_url string, source_url string, location string, workplace_type string, description_text string, salary_min double, salary_max double, salary_currency string, salary_interval string, content_hash string, raw_payload string, text_quality string, source_updated_at timestamp, ingest_query string, ingest_role_family_id string"
    names = [c.split()[0] for c in schema.split(", ")]
    filled = [{"run_id": run, "batch_pos": k, "source": "adzuna", "company_name": "Alpha", "title": "Data Engineer", "text_quality": "full_text", "ingest_query": "data", **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in filled], schema)


@pytest.fixture
def light(spark):
    """A few rows in many joins: one partition, no re-planning, no compilation."""
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("adaptive", ["false", "true"])
def test_ingest_life_of_a_posting(spark, light, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "1" if adaptive == "false" else "2")
    t = model(spark, [], [], companies=())
    t = t.with_(jobs=t.jobs.withColumn("job_key", F.lit(None).cast("string")), listings=t.listings.withColumn("ingest_query", F.lit(None).cast("string")).withColumn("ingestion_run_id", F.col("ingestion_run_id").cast("string")), observations=t.observations.withColumn("ingestion_run_id", F.col("ingestion_run_id").cast("string")))
    aliases, candidates = adapters.aliases(spark, [(1, 1, "SQL", False)]), table(spark, "duplicate_job_candidates", [])
    posting = {"source_job_id": "9", "canonical_url": "https://a.test/9", "description_text": "old"}
    runs = [[posting, {**posting, "description_text": "knows SQL"}], [], [], [], [posting]]
    states = []
    for k, rows in enumerate(runs):
        at = NOW + timedelta(days=k)
        errors = spark.createDataFrame([(f"r{k}", "adzuna", "data", None)], "run_id string, source string, ingest_query string, error string")
        out = ingest.ingest(t, aliases, candidates, batch(spark, rows, f"r{k}"), errors, at)
        out = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in out.items()}
        t = t.with_(companies=out["companies"], jobs=out["jobs"], listings=out["listings"], observations=out["observations"], job_skills=out["job_skills"])
        candidates = out["candidates"]
        states.append(out["jobs"].first()["closed_at"])
        assert out["summary"].first()["status"] == "completed"
    assert states == [None, None, None, NOW + timedelta(days=3), None]
    assert (t.jobs.count(), t.listings.count(), t.companies.count(), t.job_skills.count(), t.observations.count()) == (1, 1, 1, 1, 5)
    assert t.jobs.first()["description_text"] == "old" and t.job_skills.first()["matched_text"] == "SQL"


def test_candidate_pairs_and_decisions(spark):
    body = "Responsibilities: keep the whole platform running well. Requirements: ten years of work with large tables."
    pay = {"salary_min": 1.0, "salary_max": 2.0, "description_text": body}
    jobs = [{"id": k, "title": "Data Engineer", "company_id": 1, "canonical_url": f"u{k}"} for k in (1, 2, 3)]
    t = model(spark, jobs, [listing(1, 1, **pay), listing(2, 2, "adzuna", **pay), listing(3, 3, "lever", description_text="else")], skill_rows=[(1, "SQL"), (2, "SQL"), (2, "Go")])
    none = table(spark, "duplicate_job_candidates", [])
    after, counts = dedupe.scan_candidates(t.jobs, t.listings, none, NOW)
    row = after.first()
    assert (row["job_id"], row["candidate_job_id"], row["match_type"], row["score"]) == (1, 2, "structured_fields", 0.9)
    assert "matching salary range" in row["reason"]
    assert tuple(counts.first()) == (1, 1, 0, 1)
    decisions = spark.createDataFrame([(1, 2, "merge", "me", None, "pending")], "job_id long, candidate_job_id long, action string, actor string, reason string, expected_status string")
    out = dedupe.apply_decisions(t.jobs, t.listings, t.job_skills, after, decisions, NOW)
    assert sorted(r["job_id"] for r in out["listings"].collect()) == [1, 1, 3]
    assert {r["id"]: r["closed_at"] for r in out["jobs"].collect()} == {1: None, 2: NOW, 3: None}
    assert out["job_skills"].count() == 2 and out["candidates"].first()["status"] == "merged" and out["audit"].count() == 1


def test_merge_listings(spark):
    day = timedelta(days=1)
    rows = [listing(1, 1, source_job_id="a", last_seen_at=NOW - day, first_seen_at=NOW - 2 * day), listing(2, 2, source_job_id="a"), listing(3, 3)]
    t = model(spark, [{"id": k, "title": "A"} for k in (1, 2, 3)], rows, [{"source_listing_id": 1, "observed_at": NOW, "is_active": True}])
    moves = dedupe.merge_map(t.listings, dedupe.identity_key())
    kept, moved = dedupe.merge_listings(t.listings, t.observations, moves)
    assert {r["id"]: r["first_seen_at"] for r in kept.collect()} == {2: NOW - 2 * day, 3: NOW}
    assert moved.first()["source_listing_id"] == 2
    jobs = {r["id"]: r for r in dedupe.close_orphans(t.jobs, kept, moves, NOW).collect()}
    assert jobs[1]["closed_at"] == NOW and jobs[2]["first_seen_at"] == NOW - 2 * day


def test_archive_round_trip(spark):
    t = model(spark, [{"id": 1, "title": "A"}, {"id": 2, "title": "B"}], [listing(1, 1), listing(2, 1), listing(3, 2)], [{"source_listing_id": 3, "observed_at": NOW, "is_active": True}], [(2, "SQL")])
    pairs = table(spark, "duplicate_job_candidates", [{"job_id": 1, "candidate_job_id": 2, "status": "pending"}])
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    gone = archive.archive_listings(t.listings, t.observations, t.jobs, t.job_skills, pairs, ids, NOW)
    assert (gone.listings.count(), gone.jobs.count(), gone.job_skills.count(), gone.candidates.count(), gone.archive.count()) == (1, 1, 0, 0, 2)
    back = archive.restore_listings(gone, ids)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(t.listings, back.listings) and same(t.jobs, back.jobs) and same(t.job_skills, back.job_skills) and same(t.observations, back.observations) and same(pairs, back.candidates)
    old = gone.archive.withColumn("deleted_at", F.when(F.col("source_listing_id") == 1, F.lit(NOW - timedelta(days=3))).otherwise(F.col("deleted_at")))
    assert [r["source_listing_id"] for r in archive.list_archive(archive.purge_archive(old, NOW)).collect()] == [3]


def test_reports_run(spark):
    t = adapters.tables(spark, "/root/testdata/sf0.001")
    for report in (overview.snapshot_report(t, adapters.AS_OF), overview.trend_report(t, adapters.AS_OF, 4), overview.demand_report(t, adapters.AS_OF)):
        for frame in report.values():
            assert frame.schema
        if "facts" in report:
            report["facts"].unpersist()
    assert overview.default_trend_skill(t, adapters.AS_OF, None, "robotics").count() == 1


def test_stream(spark, tmp_path):
    from hirelens.streaming import observations as stream

    rows = [("r1", "lever", "1", 1, NOW, True), ("r1", "lever", "1", 1, NOW, True), ("r2", "lever", "1", 1, NOW, True), ("r2", "lever", "2", 2, NOW, True)]
    spark.createDataFrame(rows, stream.OBSERVATION).write.parquet(str(tmp_path / "in"))
    seen = []
    job = stream.each_batch(stream.distinct_observations(stream.read_observations(spark, str(tmp_path / "in"))), lambda df, _: seen.append((df.count(), stream.weekly_exact(df).collect())), str(tmp_path / "cp"))
    job.awaitTermination(120)
    assert seen[0][0] == 3 and seen[0][1][0]["jobs"] == 2
    counts = stream.weekly_active(stream.read_observations(spark, str(tmp_path / "in")).withWatermark("observed_at", "7 days"))
    q = counts.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(str(r["week"]), r["jobs"]) for r in spark.sql("select * from weeks").collect()] == [("2024-03-04", 2)]
