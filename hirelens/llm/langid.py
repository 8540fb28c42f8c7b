"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-cased whole texts by language, over every
training row. The matrix of log-probabilities (2^bits buckets x languages) is broadcast, and
batches are scored in numpy: the rows of the matrix at a document's bucket ids are summed,
which is the product of a sparse count matrix with it. Of more than LANGUAGES languages the
matrix comes in blocks of as many columns, one after the other, and each pass over the
documents carries on the best language so far and the sum of all likelihoods.

Cases: null text or text without a letter gives `und` with score 0; nothing learned gives
`und` for all; a null language is not learned from; repeated rows count again; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import char_blocks, held_out, ngram_hashes, stored

ORDERS, BITS, LANGUAGES = (1, 2, 3), 15, 512


def ngram_counts(docs: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """(lang, bucket, n) over all rows; bucket -1 counts documents."""
    longest = max(orders)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            texts = [(t or "").lower() for t in batch["text"].to_pylist()]
            for name in names:
                sums.setdefault(name, np.zeros(1 << bits, np.int64))
                rows[name] = rows.get(name, 0) + langs.count(name)
            for codes, owner in char_blocks(texts, longest):
                for n in orders:
                    h, who = ngram_hashes(codes, owner, n, longest, bits)
                    grid = np.bincount(h + (number[who] << bits), minlength=len(names) << bits)
                    for k, name in enumerate(names):
                        sums[name] += grid[k << bits : (k + 1) << bits]
        for name, total in sums.items():
            (at,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[rows[name], total[at]])], ["lang", "bucket", "n"])

    counted = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


Model = tuple[list[str], np.ndarray, np.ndarray]


def fit(train: DataFrame, bits: int = BITS, languages: int = LANGUAGES) -> Iterator[Model]:
    """Blocks of (languages, log-prior of each, log-probabilities [bucket, language]); one empty block if nothing is learned."""
    counts = stored(ngram_counts(train, bits=bits))
    known = counts.where("bucket = -1").orderBy("lang").toArrow()  # a row a language
    names, docs = known["lang"].to_pylist(), np.array(known["n"], np.float64)
    for low in range(0, max(len(names), 1), languages):
        own = names[low : low + languages]
        block = counts.where(F.col("lang").between(own[0], own[-1]) & (F.col("bucket") >= 0)).toArrow() if own else None  # at most 2^bits rows a language
        grams = np.full((len(own), 1 << bits), 0.5)
        if own:
            place = {name: k for k, name in enumerate(own)}
            grams[np.array([place[x] for x in block["lang"].to_pylist()], np.int64), np.array(block["bucket"], np.int64)] += np.array(block["n"])
        logs = np.log(grams / grams.sum(axis=1, keepdims=True))
        prior = np.log(docs[low : low + len(own)] / docs.sum()) if own else np.empty(0)
        yield own, prior.astype(np.float32), np.ascontiguousarray(logs.T.astype(np.float32))


def _carry_on(rows: DataFrame, model: Model, orders: tuple[int, ...], bits: int, more: bool) -> DataFrame:
    """doc_id, held_out, letter, best, top, total after one more block: the best language, its log-likelihood, and the log of all likelihoods' sum; and text if more blocks follow."""
    columns = ["doc_id", "held_out", "letter", "best", "top", "total"] + ["text"] * more
    shared = rows.sparkSession.sparkContext.broadcast(model)
    longest = max(orders)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, logs = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                texts = [t or "" for t in part["text"].to_pylist()]
                best, top, total = part["best"].to_pylist(), np.array(part["top"]), np.array(part["total"])
                if names:
                    sums = np.tile(prior.astype(np.float64), (len(texts), 1))
                    for codes, owner in char_blocks([t.lower() for t in texts], longest):
                        for n in orders:
                            h, who = ngram_hashes(codes, owner, n, longest, bits)
                            if len(h):
                                starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                                np.add.at(sums, who[starts], np.add.reduceat(logs[h], starts, axis=0, dtype=np.float64))
                    own = sums.argmax(axis=1)
                    most = sums.max(axis=1)
                    total = np.logaddexp(total, most + np.log(np.exp(sums - most[:, None]).sum(axis=1)))
                    best = [names[k] if m > t else b for k, m, t, b in zip(own.tolist(), most.tolist(), top.tolist(), best, strict=True)]
                    top = np.maximum(top, most)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], part["letter"], pa.array(best, pa.string()), pa.array(top), pa.array(total)] + [part["text"]] * more, columns)

    return rows.mapInArrow(score, "doc_id long, held_out boolean, letter boolean, best string, top double, total double" + ", text string" * more)


def predict(docs: DataFrame, models: Iterator[Model], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior probability of lang_pred)."""
    least = F.lit(float("-inf"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), letter, F.lit(None).cast("string").alias("best"), least.alias("top"), least.alias("total"), "text")
    model = next(models)
    while model is not None:
        after = next(models, None)
        rows = _carry_on(rows, model, orders, bits, after is not None)
        rows, model = rows if after is None else stored(rows), after
    known = F.col("best").isNotNull() & F.col("letter")
    return rows.select("doc_id", "held_out", F.when(known, F.col("best")).otherwise("und").alias("lang_pred"), F.when(known, F.exp(F.col("top") - F.col("total"))).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    return predict(docs, fit(docs.where(~held_out()), languages=languages))
