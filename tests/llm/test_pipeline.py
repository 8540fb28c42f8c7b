import __spark_entry__
import corpus_pipeline
from hirelens.llm import decontam, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Each stage keeps the columns and does its work on what the one before kept; the last packs all that is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        kept.append(after.count())
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert decontam.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept[-1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    assert toxicity.ORDERS


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
