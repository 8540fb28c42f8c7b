"""The corpus pipeline: toxic documents out, repeated lines out, near copies out, benchmark leaks out, then packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelens.llm import decontam, line_dedup, ngram_join, packing, toxicity
from hirelens.llm.common import stored

#: The pipeline's near copies are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
NEAR = {"size": 5, "percent": 80}
#: The stages before packing leave the executors' heaps full, so its Python workers keep fewer encoded chunks than a run of its own.
KEPT = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_lines(docs, line_dedup.removed_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, **NEAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, kept=KEPT)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]

#: SQL has neither a trained classifier nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
