"""What keeps memory and disk bounded on large tables gives the same results."""

import os

from pyspark.sql import functions as F

from hirelens.functions import text
from hirelens.operators import ingest, paging, search
from hirelens.sources import merge, readers
from hirelens.sources.merge import MergedTable
from test_operators import NOW, batch, table


def test_large_merge_part_by_part(spark, monkeypatch, tmp_path):
    """A batch over GROUP_ROWS goes in some parts at a time, with the same result; neither shuffle files nor intermediate tables stay."""
    monkeypatch.setattr(merge, "GROUP_ROWS", 20)
    table = MergedTable(spark, "merged_by_parts", ["k"], parts=8, buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.create(frame([(k, f"v{k}") for k in range(0, 200, 2)]))
    sizes, folder = [], f"{tmp_path}/shared"
    monkeypatch.setattr(merge, "shared_dir", lambda spark: folder)

    def upsert(old, fresh):
        sizes.append(fresh.count())
        return old.alias("o").join(fresh.alias("n"), "k", "full").select("k", F.coalesce("n.v", "o.v").alias("v"))

    new = [(k, f"v{k}" if k < 100 else "new") for k in range(120)] + [(None, "x")]
    assert table.merge(frame(new), upsert) == list(range(8)) and table.merge(frame(new), upsert) == []
    assert {r["k"]: r["v"] for r in table.read().collect()} == {**{k: f"v{k}" for k in range(0, 200, 2)}, **{k: v for k, v in new if k is not None}}
    assert sum(sizes) == 240 and len(sizes) > 8 and not os.path.exists(folder)


def test_jobs_of_companies_that_share_a_name(spark):
    """Two companies of one normalised name: their job comes once."""
    out = ingest.upsert_jobs(table(spark, "jobs", []).withColumn("job_key", F.lit("")), batch(spark, [{"source_job_id": "9", "canonical_url": "https://a.test/9"}], "r"), spark.createDataFrame([(5, "alpha"), (4, "alpha")], "id long, normalized_name string"), NOW)
    assert [r["company_id"] for r in out.collect()] == [4]


def test_long_pages_from_sorted_ranges(spark, monkeypatch):
    """Pages over PAGE_ROWS hold the same rows in the same order, no task sorts all rows, and places run on."""
    monkeypatch.setattr(paging, "PAGE_ROWS", 10)
    rows = spark.createDataFrame([(k, float(k * 7 % 20) if k % 5 else None) for k in range(200)], "id long, pay double").repartition(5)
    order, last, got = [("pay", True), ("id", False)], None, []
    want = [r["id"] for r in rows.orderBy(F.desc("pay"), "id").collect()]
    while True:
        assert sorted((r["place"], r["id"]) for r in paging.placed(rows, order, 60, last).collect()) == list(enumerate(want[len(got) : len(got) + 60], 1))
        shown = paging.page(rows, order, 60, last)
        assert "TakeOrdered" not in shown._jdf.queryExecution().toString()
        got += [r["id"] for r in shown.collect()]
        last = paging.cursor(shown, order)
        if last is None:
            break
    assert got == want and paging.placed(rows.limit(0), order, 60).count() == 0


def test_pages_of_folders_are_read_one_after_another(spark, tmp_path, monkeypatch):
    """Postings of pages in folders, deeper ones too; listings of one folder at a time; pages without an envelope."""
    for folder, name, page in (("a", "1", '{"results":[{"x":1},{"x":2}]}'), ("b/c", "2", '{"results":[{"x":3}]}'), ("b", "3", '{"results":[]}'), ("d", "4", '{"other":1}')):
        os.makedirs(f"{tmp_path}/in/{folder}", exist_ok=True)
        with open(f"{tmp_path}/in/{folder}/{name}.json", "w") as out:
            out.write(page)
    read, own = [], readers._pages
    monkeypatch.setattr(readers, "_pages", lambda spark, path: read.append(path) or own(spark, path))
    cost = spark.conf.get(readers.OPEN_COST)
    rows, rejects = readers.read_raw_postings(spark, f"file://{tmp_path}/in", "adzuna", strict=False)
    assert sorted((r["file"][-6:], r["page_pos"], r["posting"]) for r in rows.collect()) == [("1.json", 0, '{"x":1}'), ("1.json", 1, '{"x":2}'), ("2.json", 0, '{"x":3}')]
    assert [r["value"] for r in rejects.collect()] == ['{"other":1}'] and [p[-1] for p in read] == ["a", "b", "d"] and spark.conf.get(readers.OPEN_COST) == cost


def test_index_leaves_no_shuffle_files_and_short_keys(spark, tmp_path):
    view = spark.createDataFrame([(k, "Data Engineer", f"Firm {k % 3}", None) for k in range(9)], "id long, title string, company string, description_text string")
    index = search.build(view, folder=f"{tmp_path}/index")
    assert {r["id"] for r in index.search(view, q="firm 1").collect()} == {1, 4, 7} and index.texts.count() == 4
    assert index.texts.schema["text_key"].dataType.simpleString() == "binary" and len(index.texts.first()["text_key"]) == 32


def test_clean_trims_every_blank(spark):
    """Trimmed as the pattern of Unicode blanks trims, which is slower."""
    parts = ["", " ", "\t\n", " x　", "  a  b \u0085", "\x1c y \x1f", "﻿z ", None]
    rows = spark.createDataFrame([(p,) for p in parts], "s string").select(text.clean("s").alias("a"), F.regexp_replace(F.coalesce("s", F.lit("")), r"(?U)^\s+|\s+$", "").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and "x" in {r["a"] for r in rows}
