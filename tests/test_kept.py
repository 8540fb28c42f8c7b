"""Results that are kept up to date run by run: keyed state, streams, bitmaps."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirelens.operators import bitmaps, dedupe, duplicate_classes, intervals, paging, ranks, search
from hirelens.operators.active import search_listings
from hirelens.schemas import Tables
from hirelens.sources.merge import MergedTable
from hirelens.streaming import lifecycle, observations
from test_operators import NOW, listing, model, table

DAY, FIRST = timedelta(days=1), datetime(2024, 3, 4)


def polls(spark, folder, runs):
    """Lands the runs [(day, listings found)], each with its end."""
    rows = [(i, FIRST + day * DAY, True) for day, found in runs for i in found] + [(None, FIRST + day * DAY + DAY / 2, False) for day, _ in runs]
    rows += rows[:1]  # a repeated row
    spark.createDataFrame(rows, lifecycle.POLL).coalesce(1).write.mode("append").parquet(f"{folder}/landing")


def follow(spark, folder):
    lifecycle.follow(spark, f"{folder}/landing", f"{folder}/events", f"{folder}/checkpoint", DAY).awaitTermination(120)


def events(spark, folder):
    out = spark.read.schema(lifecycle.EVENT).parquet(f"{folder}/events").collect()
    return sorted((r["source_listing_id"], (r["at"] - FIRST).days, {"missed": 1, "closed": 2}.get(r["event"], 0), r["event"], r["misses"]) for r in out)


def expected(runs):
    found, out = {}, []
    for day, own in runs:
        for i in sorted(set(own) | set(found)):
            if i in own:
                if i not in found:
                    out.append((i, day, 0, "found", 0))
                elif found[i]:
                    out.append((i, day, 0, "reopened" if found[i] >= 3 else "found", 0))
                found[i] = 0
            elif found[i] < 3:
                found[i] += 1
                out.append((i, day, 1, "missed", found[i]))
                if found[i] == 3:
                    out.append((i, day, 2, "closed", 3))
    return sorted(out)


@pytest.mark.parametrize("split", [[2, 7, 12], [12]])
def test_lifecycle_however_runs_are_split(spark, tmp_path, split):
    """The same events from any split into landings, each after a restart, as a look back at all runs gives."""
    pick = random.Random(5)
    runs = [(day, [i for i in range(4) if pick.random() < 0.45]) for day in range(12)]
    at = 0
    for to in split:
        polls(spark, tmp_path, runs[at:to])
        follow(spark, tmp_path)
        at = to
    got = events(spark, tmp_path)
    assert got == expected(runs) and {"closed", "reopened", "missed", "found"} <= {e[3] for e in got}
    states = {r["source_listing_id"]: r for r in lifecycle.listing_states(spark.read.schema(lifecycle.EVENT).parquet(f"{tmp_path}/events")).collect()}
    for i, r in states.items():
        own = [e for e in got if e[0] == i]
        assert (r["misses"], r["closings"]) == (own[-1][4], sum(e[3] == "closed" for e in own))
    listings = spark.createDataFrame([(i, i // 2) for i in range(4)] + [(9, 4), (10, None)], "id long, job_id long")
    closed = {r["job_id"] for r in lifecycle.closed_jobs(listings, lifecycle.listing_states(spark.read.schema(lifecycle.EVENT).parquet(f"{tmp_path}/events"))).collect()}
    now = {i: r["misses"] for i, r in states.items()}
    assert closed == {j for j in (0, 1) if min(now.get(2 * j, 0), now.get(2 * j + 1, 0)) > 0 and max(now.get(2 * j, 0), now.get(2 * j + 1, 0)) >= 3}


def test_weekly_stream_restarts(spark, tmp_path):
    """Late and repeated rows are left out, a second start takes in only what is new."""
    row = lambda k, job, day, active=True: ("r", "lever", str(k), job, FIRST + day * DAY, active)
    landings = [[row(1, 1, 0), row(1, 1, 0), row(2, 2, 1), row(3, 3, 1, False)], [row(4, 1, 20), row(1, 1, 0)], [row(5, 9, 1), row(6, None, 20), row(7, 2, 21)], []]
    for rows in landings:
        spark.createDataFrame(rows, observations.OBSERVATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        observations.follow_weekly(spark, f"{tmp_path}/landing", f"{tmp_path}/weeks", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = {str(r["week"]): r["jobs"] for r in observations.weekly_of(spark.read.parquet(f"{tmp_path}/weeks")).collect()}
    assert got == {"2024-03-04": 2, "2024-03-18": 1, "2024-03-25": 1}


def test_bitmaps_of_runs(spark):
    """Merged in any order and repeated, they count as one pass does; numbers stay and have no gaps."""
    pick = random.Random(3)
    rows = [(pick.choice("ab"), pick.randrange(-(10**12), 10**12) if pick.random() < 0.5 else pick.randrange(40)) for _ in range(400)] + [("a", None)]
    frame = spark.createDataFrame(rows, "g string, job_id long")
    numbers, whole = spark.createDataFrame([], "job_id long, number long"), None
    for part in (0, 1, 2, 1):
        own = frame.where(F.pmod(F.hash("job_id"), F.lit(3)) == part)
        before = {r["job_id"]: r["number"] for r in numbers.collect()}
        numbers = bitmaps.number_jobs(numbers, own)
        after = {r["job_id"]: r["number"] for r in numbers.collect()}
        assert before.items() <= after.items() and sorted(after.values()) == list(range(len(after)))
        new = bitmaps.bitmaps_of(own.join(numbers, "job_id"), ["g"])
        whole = new if whole is None else bitmaps.merged(whole, new, ["g"])
    got = {r["g"]: r["n"] for r in bitmaps.counts_of(whole, ["g"], "n").collect()}
    assert got == {g: len({j for x, j in rows if x == g and j is not None}) for g in "ab"}
    assert len(after) == len({j for _, j in rows if j is not None})


def files_of(spark, table):
    return {f: p for f in table.stored().inputFiles() for p in [f.split("_part=")[1].split("/")[0]]}


def test_merge_rewrites_only_what_changes(spark):
    """One key in a hundred: other parts keep their files, the stored side isn't shuffled, a repeated merge writes nothing."""
    table = MergedTable(spark, "merged_test", ["k"], parts=32, buckets=4)
    rows = [(k, f"v{k}", None if k % 7 == 0 else k * 1.5) for k in range(1000)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, w double")
    table.create(frame([*rows, (None, "no key", 0.0)]))
    before = files_of(spark, table)
    new = [(k, "new", None) for k in range(0, 1000, 100)] + [(5000, "more", 1.0), (None, "x", 1.0)] + [(7, "v7", None)]
    plans = []

    def upsert(old, fresh):
        out = old.alias("o").join(fresh.alias("n"), "k", "full").select("k", F.coalesce("n.v", "o.v").alias("v"), F.when(F.col("n.v").isNotNull(), F.col("n.w")).otherwise(F.col("o.w")).alias("w"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    touched = table.merge(frame(new), upsert)
    want = {**{k: (v, w) for k, v, w in rows}, **{k: (v, w) for k, v, w in new if k is not None}}
    assert {r["k"]: (r["v"], r["w"]) for r in table.read().collect()} == want
    after = files_of(spark, table)
    assert 0 < len(touched) <= 11 and {f: p for f, p in before.items() if int(p) not in touched} == {f: p for f, p in after.items() if int(p) not in touched}
    assert "Bucketed: true" in plans[0] and plans[0].count("Exchange hashpartitioning") == 1  # the new rows' side
    assert table.merge(frame(new), upsert) == [] and table.merge(frame([]), upsert) == [] and files_of(spark, table) == after


def test_intervals_follow_the_log(spark):
    """Active sets at any time equal those of the log up to it, folded at once or run by run; ties, repeats and nulls among the rows."""
    pick = random.Random(9)
    log = [(pick.randrange(12), FIRST + DAY * pick.randrange(20), pick.random() < 0.6) for _ in range(150)]
    log += log[:10] + [(None, FIRST, True), (3, None, True), (3, FIRST, None)]
    frame = spark.createDataFrame(log, "source_listing_id long, observed_at timestamp, is_active boolean")
    listings = spark.createDataFrame([(i, i % 5, "s") for i in range(14)], "id long, job_id long, source string")
    jobs = spark.createDataFrame([(j, FIRST + 8 * DAY if j == 1 else None) for j in range(5)], "id long, closed_at timestamp")
    t = Tables(jobs, jobs, listings, frame, jobs, jobs)
    times = [FIRST + DAY * k - DAY / 2 for k in (0, 3, 8, 9, 30)]
    want = set()
    for at in times:
        for i in range(14):
            seen = [(o, a) for k, o, a in log if k == i and o is not None and a is not None and o <= at]
            newest = max((o for o, _ in seen), default=None)
            if (newest is None or any(a for o, a in seen if o == newest)) and not (i % 5 == 1 and FIRST + 8 * DAY <= at):
                want.add((at, i))
    whole = intervals.validity(frame)
    middle = F.lit(FIRST + 9 * DAY)
    early = intervals.validity(frame.where(F.col("observed_at") < middle))
    steps = intervals.extended(early, frame.where(F.col("observed_at") >= middle))
    assert sorted(map(str, whole.collect())) == sorted(map(str, steps.select(*whole.columns).collect()))
    assert {(r["as_of"], r["id"]) for r in intervals.active_at(t, whole, times).collect()} == want
    with pytest.raises(ValueError, match="older"):
        intervals.extended(whole, frame.limit(1).withColumn("observed_at", F.lit(FIRST - DAY)))
    none = frame.limit(0)
    assert intervals.validity(none).count() == 0 and intervals.active_at(t, intervals.validity(none), times[:1]).count() == 14


def test_percentiles_by_rank(spark):
    pick = random.Random(2)
    rows = [(g, pick.choice([None, float(pick.randrange(5)), pick.random() * 100])) for g in ["a"] * 300 + ["b"] * 7 + [None] * 20] + [("one", 4.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in ranks.exact_percentiles(frame, ["g"], "x", {"low": 0.0, "p25": 0.25, "median": 0.5, "high": 1.0}).collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(x for k, x in rows if k == g and x is not None)
        for name, share in (("low", 0.0), ("p25", 0.25), ("median", 0.5), ("high", 1.0)):
            at = (len(own) - 1) * share
            low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            assert abs(got[g][name] - (low + (high - low) * (at - int(at)))) < 1e-9
        assert got[g]["count"] == len(own)
    assert "none" not in got


@pytest.mark.parametrize("descending", [False, True])
def test_pages_chain_to_the_end(spark, descending):
    pick = random.Random(4)
    rows = [(i, pick.choice([None, 1.0, 2.0, 2.5]), pick.choice([None, "x", "y"])) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, a double, b string").repartition(3)
    order, last, seen = [("a", descending), ("b", not descending), ("id", False)], None, []
    for _ in range(8):
        shown = paging.page(frame, order, 7, last)
        own = [tuple(r) for r in shown.select("id").collect()]
        seen += own
        last = paging.cursor(shown, order)
        if not own:
            assert last is None
            break
    whole = frame.orderBy(F.col("a").desc() if descending else F.col("a").asc(), F.col("b").asc() if descending else F.col("b").desc(), "id").select("id").collect()
    assert seen == [tuple(r) for r in whole]


def test_search_by_postings(spark):
    """Any needle finds what a scan finds, short ones and rare runs too, and few texts are read for it."""
    words = "data engineer lead of the platform naïve größe a1 x".split()
    pick = random.Random(6)
    rows = [(i, pick.choice(["Data  Engineer", "Lead", None, ""]), pick.choice(["Alpha", "Big X", None]), " ".join(pick.choice(words) for _ in range(8)) + f" no {i}", pick.choice("ab"), "r") for i in range(60)]
    view = spark.createDataFrame(rows, "id long, title string, company string, description_text string, source string, role_family string")
    index = search.build(view)
    for needle in ["data engineer", "DATA   eng", "x", "ï", "no 3", "no 33", "zzz", "a1 x", "g x", " ", None, "größe lead", "e"]:
        want = {r["id"] for r in search_listings(view, "a" if needle == "x" else None, None, needle).collect()}
        assert {r["id"] for r in index.search(view, "a" if needle == "x" else None, None, needle).collect()} == want, needle
    assert index.candidates("no 33").count() == 1 < index.texts.count()


def test_boilerplate_pairs_as_profiles(spark, monkeypatch):
    """Many jobs of one text and few profiles: links, classes and the listed pairs are those of all pairs; rows grow with profiles."""
    monkeypatch.setattr(duplicate_classes, "BLOCK", 4)
    body = "Responsibilities: keep the whole platform running well. Requirements: ten years of work with large tables."
    jobs, rows = [], []
    for k in range(1, 61):
        jobs.append({"id": k, "title": "Data Engineer", "company_id": 1 + (k > 55), "canonical_url": None if k == 3 else f"u{k}", "location": "Here" if k % 10 == 0 else None, "content_hash": "h" if k in (7, 8) else None, "closed_at": FIRST if k == 5 else None})
        rows.append(listing(k, k, ("lever", "adzuna", "jobstreet")[k % 3], description_text=body if k % 7 else None, salary_min=1.0 * (k % 2 + 1), salary_max=2.0))
    rows.append(listing(100, 4, "greenhouse", description_text=body))
    t = model(spark, jobs, rows)
    pairs = sorted(map(tuple, dedupe.candidate_pairs(t.jobs, t.listings).collect()))
    members = duplicate_classes.profiles(t.jobs, t.listings)
    links = duplicate_classes.profile_links(t.jobs, t.listings, members)
    assert sorted(map(tuple, duplicate_classes.expanded(members, links).select("job_id", "candidate_job_id", "match_type", "score", "reason").collect())) == pairs
    assert len(pairs) > 500 > 5 * links.count()
    root, count = {}, Counter()
    for a, b, *_ in pairs:
        count[a] += 1
        count[b] += 1
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b, *_ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["job_id"]: (r["class_id"], r["links"]) for r in duplicate_classes.duplicate_classes(members, links).collect()}
    assert got == {j: (root[j], count[j]) for j in root}


def test_classes_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    got = {r["id"]: r["class_id"] for r in duplicate_classes.components(links, "a", "b").collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_coded_pairs_are_the_candidate_pairs(spark, monkeypatch):
    """Profiles without salaries, pairs of equal salaries, shared URLs, places and hashes; the texts of many jobs are read as often as they differ."""
    monkeypatch.setattr(duplicate_classes, "BLOCK", 4)
    bodies = [f"Responsibilities: keep the whole platform number {a} running well. Requirements: {b} years of work with large tables.{c}" for a in (1, 2) for b in ("ten", "two") for c in ("", " Preferred qualifications: a taste for long evenings.")] + ["short", "a longer text that has no sections at all", None]
    jobs, rows = [], []
    for k in range(1, 91):
        jobs.append({"id": k, "title": "Data Engineer" if k % 3 else "Clerk", "company_id": 1 + (k > 80), "canonical_url": None if k % 17 == 0 else f"u{k % 40}", "location": "Here" if k % 10 == 0 else None, "content_hash": "h" if k in (7, 8, 16) else None, "closed_at": FIRST if k == 5 else None})
        for n in range(1 + k % 3):
            pay = None if (k + n) % 4 == 0 else 1.0 * (k % 5 + 1)
            rows.append(listing(k * 10 + n, k, ("lever", "adzuna", "jobstreet")[(k + n) % 3], description_text=bodies[(k * 7 + n) % len(bodies)], salary_min=pay, salary_max=2.0 if k % 6 else None, salary_currency=("SGD", "usd", None)[k % 3], workplace_type="At home on most of the days" if k % 4 == 0 else None))
    t = model(spark, jobs, rows)
    want = sorted(map(tuple, dedupe.candidate_pairs(t.jobs, t.listings).collect()))
    assert len(want) > 300 and {r[2] for r in want} > {"content_hash", "structured_fields", "structured_fields_salary"}
    for most in (100_000, 0):  # salaried pairs broadcast, and joined
        monkeypatch.setattr(duplicate_classes, "BROADCAST_PAIRS", most)
        assert sorted(map(tuple, duplicate_classes.decoded(duplicate_classes.coded_pairs(t.jobs, t.listings)).collect())) == want
    pairs = duplicate_classes.coded_pairs(t.jobs, t.listings)
    first = duplicate_classes.upsert_coded(table(spark, "duplicate_job_candidates", []), pairs, FIRST)
    old = first.where("job_id % 2 = 0").withColumns({"score": F.lit(0.9), "status": F.lit("dismissed")}).unionByName(first.limit(1).withColumns({"job_id": F.lit(-1).cast("long")}))
    order = ["job_id", "candidate_job_id", "match_type", "score", "reason", "status", "created_at"]
    old = spark.createDataFrame(old.collect(), old.schema)
    both = [sorted(map(tuple, df.select(*order).collect())) for df in (duplicate_classes.upsert_coded(old, pairs, NOW), dedupe.upsert_candidates(old, duplicate_classes.decoded(pairs), NOW))]
    assert both[0] == both[1] and len(both[0]) == len(want) + 1
