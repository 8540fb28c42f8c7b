"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed 4- and 5-grams of the lower-cased whole text. On a bounded
sample of labelled rows (SAMPLE of each label, those with the smallest hash of their id) the
log-count ratio of each feature between toxic and other rows is taken; features with fewer
than SUPPORT rows, or whose ratio is small, weigh nothing. A logistic regression with a
squared penalty is fitted on the ratios. Its intercept is moved from the sample's to the
share of toxic rows among all labelled rows.

Cases: null and empty texts are scored by the intercept; without toxic or other labels every
score is 0; null labels are not learned from; repeated rows are scored again; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import char_blocks, held_out, ngram_hashes

ORDERS, BITS = (4, 5), 20
SAMPLE, SUPPORT, LEAST_RATIO, PENALTY, STEPS = 2000, 8, 1.5, 1e-3, 300


def _grams(texts: list[str], weights: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct n-grams of each text, or only of those with a weight."""
    keys = []
    for codes, owner in char_blocks([t.lower() for t in texts], max(ORDERS)):
        for n in ORDERS:
            h, who = ngram_hashes(codes, owner, n, max(ORDERS), bits)
            if weights is not None:
                own = weights[h] != 0
                h, who = h[own], who[own]
            keys.append(np.unique(who << bits | h))
    both = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """(weight of each bucket, intercept); None if either label is missing."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out()).distinct()
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows

    def features(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                who, bucket = _grams([t or "" for t in part["text"].to_pylist()], wanted, bits)
                ends = np.searchsorted(who, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["toxic"], pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["toxic", "ids"])

    schema = "toxic int, ids array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("toxic", "text")
    every = rows.mapInArrow(lambda batches: features(batches, None), schema)
    marked = every.select("toxic", F.explode(F.array_append("ids", -1)).alias("bucket"))  # bucket -1 counts rows
    found = marked.groupBy("bucket").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("other"))
    found = found.where((F.col("bucket") < 0) | (F.col("toxic") + F.col("other") >= SUPPORT)).toArrow()  # at most 2^bits rows
    at, toxic, other = (np.array(found[c]) for c in ("bucket", "toxic", "other"))
    if not (at < 0).any() or min(toxic[at < 0][0], other[at < 0][0]) == 0:
        return None
    ratio = np.zeros(1 << bits, np.float32)
    ratio[at[at >= 0]] = (np.log((toxic + 1) / (toxic[at < 0] + 2)) - np.log((other + 1) / (other[at < 0] + 2)))[at >= 0]
    ratio[np.abs(ratio) < LEAST_RATIO] = 0
    kept = docs.sparkSession.sparkContext.broadcast(ratio)
    table = rows.mapInArrow(lambda batches: features(batches, kept.value), schema).toArrow()
    y = np.array(table["toxic"], np.float64)
    ids = table["ids"].to_pylist()
    row, bucket = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array([b for x in ids for b in x], np.int64)
    used, column = np.unique(bucket, return_inverse=True)
    value = ratio[used][column]
    w, b = np.zeros(len(used)), 0.0
    moment, speed = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], len(y)) + b, -50, 50))) - y
        grad = np.r_[np.bincount(column, value * error[row], len(used)) / len(y) + PENALTY * w, error.mean()]
        moment, speed = 0.9 * moment + 0.1 * grad, 0.99 * speed + 0.01 * grad**2
        move = 0.05 * moment / (1 - 0.9**step) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w * ratio[used]
    b += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    return weights, float(b)


def _scores(texts: list[str | None], model: tuple[np.ndarray, float] | None, bits: int) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    weights, b = model
    who, bucket = _grams([t or "" for t in texts], weights, bits)
    return 1 / (1 + np.exp(-np.clip(np.bincount(who, weights[bucket], len(texts)) + b, -50, 50)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                p = _scores(part["text"].to_pylist(), shared.value, bits)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bits))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                yield part.filter(pa.array(_scores(part["text"].to_pylist(), shared.value, bits) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
