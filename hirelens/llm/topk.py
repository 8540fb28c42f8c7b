"""Exact top-k search by block-at-a-time pruning.

Rows are ordered so that like vectors lie near each other (signs of a few fixed projections, then id)
and cut into blocks; a block keeps its vectors (the forward index) and the largest and smallest
value of each component. For a query, the sum over components of the larger of value * largest and
value * smallest is a score that no row of the block passes. A query takes the blocks in the order of
that sum and scores through their vectors until the sum falls below its k-th best score.

A query is a row itself, so its own block gives it a k-th best to begin with, without a shuffle. Blocks'
bounds are compared with that first, on a grid of bounded cells; only blocks that some query of a group
needs are sent to that group, again in bounded cells, and each cell hands on at most k rows a query.

Cases: rows with a null id or vector, or a null or non-finite component, take no part; vectors of other
lengths do not meet; rows that repeat an id are candidates of their own, but never of a query with that id,
and of queries that repeat an id the one with the least vector (by its bytes) stands; ties go to the
smaller id; a query of fewer than k others gets all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import stored
from hirelens.llm.vectors import CELL_ASKS, copied, group_of, packed, product, totals

#: Projections whose signs order the rows, rows of queries scored at a time, blocks whose bounds one cell compares.
SIGNS, ROWS, CELL_BOUNDS = 12, 2048, 4096
LEAST = -(1 << 63)
ASK = "query_id long, dims int, vector binary, least long, part int"


def extremes(x: np.ndarray) -> list[np.ndarray]:
    """The largest and the smallest value of each component."""
    return [x.max(axis=0), x.min(axis=0)]


def signs(vectors: pd.Series) -> pd.Series:
    """A number of the signs of fixed projections; 0 for what takes no part."""
    out = np.zeros(len(vectors), np.int32)
    lengths = np.array([-1 if v is None else len(v) for v in vectors])
    for dims in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dims)
        x = np.nan_to_num(np.stack([np.asarray(vectors.iloc[r], np.float64) for r in rows]), nan=0.0, posinf=0.0, neginf=0.0)
        # component j counts with the sign of a bit of j times an odd number
        turn = 1 - 2 * (np.arange(dims)[:, None] * ((2 * np.arange(SIGNS) + 3) * 0x9E3779B1) >> 13 & 1)
        out[rows] = ((x @ turn > 0) << np.arange(SIGNS)).sum(axis=1)
    return pd.Series(out)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, a score that no row of the block passes."""
    return product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)


def _asking(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for b in frame.itertuples():
                rows = np.flatnonzero(np.frombuffer(b.asks, bool))
                ids = np.frombuffer(b.ids, np.int64)
                x = np.frombuffer(b.matrix, np.int32).astype(np.int64).reshape(b.n, b.dims)
                least = np.full(len(rows), LEAST)
                for at in range(0, len(rows), ROWS):
                    own = rows[at : at + ROWS]
                    scores = product(x[own], x)
                    scores[ids[own][:, None] == ids] = LEAST
                    if b.n >= k:
                        least[at : at + ROWS] = np.partition(scores, b.n - k, axis=1)[:, b.n - k]
                yield pd.DataFrame({"query_id": ids[rows], "dims": np.int32(b.dims), "vector": [x[r].astype(np.int32).tobytes() for r in rows], "least": least, "part": np.int32(b.part)})

    return run


def _vectors(asks: pd.DataFrame, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(asks.vector), np.int32).astype(np.int64).reshape(len(asks), dims)


def _stack(columns: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(columns), np.int64).reshape(-1, dims) if dims else np.zeros((len(columns), 0), np.int64)


def _needed(key: tuple, asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks that some query of the group must see."""
    dims, r = int(key[0]), int(key[1])
    if len(asks) and len(blocks):
        q, high, low = _vectors(asks, dims), _stack(blocks.high, dims), _stack(blocks.low, dims)
        needed = np.zeros(len(blocks), bool)
        for at in range(0, len(q), ROWS):
            needed |= (bounds(q[at : at + ROWS], high, low) >= asks.least.to_numpy()[at : at + ROWS, None]).any(axis=0)
        blocks = blocks[needed]
    else:
        blocks = blocks[:0]
    return pd.DataFrame({"r": np.int32(r), "part": blocks.part, "seq": blocks.seq})


def _searched(k: int):
    def cell(key: tuple, asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The best k rows of this cell for each of its queries, as far as they can count."""
        found: list[tuple] = []
        own = asks.query_id.to_numpy(np.int64)
        if len(asks) and len(blocks):
            dims = int(key[0])
            q, rest = _vectors(asks, dims), bounds(_vectors(asks, dims), _stack(blocks.high, dims), _stack(blocks.low, dims))
            kth = asks.least.to_numpy(np.int64).copy()
            top = np.full((len(q), k), LEAST)
            order = np.argsort(-rest, axis=1, kind="stable")
            ids = [np.frombuffer(b, np.int64) for b in blocks.ids]
            rows = [np.frombuffer(b, np.int32).astype(np.int64).reshape(-1, dims) if dims else np.zeros((len(i), 0), np.int64) for b, i in zip(blocks.matrix, ids, strict=True)]
            going = np.arange(len(q))
            for turn in range(order.shape[1]):
                block = order[going, turn]
                open_ = rest[going, block] >= kth[going]
                going, block = going[open_], block[open_]  # bounds fall along the order: what stops has ended
                for b in np.unique(block):
                    asking = going[block == b]
                    for at in range(0, len(asking), ROWS):
                        who = asking[at : at + ROWS]
                        scores = product(q[who], rows[b])
                        scores[own[who][:, None] == ids[b]] = LEAST
                        i, j = np.nonzero((scores >= kth[who][:, None]) & (scores > LEAST))
                        found.append((who[i], ids[b][j], scores[i, j]))
                        both = np.concatenate([top[who], scores], axis=1)
                        top[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                        kth[who] = np.maximum(kth[who], top[who].min(axis=1))
                if not len(going):
                    break
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        who, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = score >= kth[who]
        who, vec, score = who[keep], vec[keep], score[keep]
        by = np.lexsort((vec, -score, who))
        who, vec, score = who[by], vec[by], score[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return pd.DataFrame({"query_id": own[who], "vec_id": vec, "score": score})[place < k]

    return cell


def top_k(rows: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query row."""
    near = F.pandas_udf(signs, "int")
    source = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"), F.lit(0).alias("label"), queries.alias("asks"))
    ordered = source.withColumn("near", near("vector")).repartitionByRange("near", "id").sortWithinPartitions("near", "id")
    blocks = stored(packed(ordered, scale, extremes, ", high binary, low binary"))
    asks = blocks.mapInPandas(_asking(k), ASK)
    asks = stored(asks.groupBy("query_id").agg(F.min(F.struct("vector", "dims", "least", "part")).alias("q")).select("query_id", "q.*"))
    r, s = totals(blocks, asks)
    # queries that lie near each other need the same blocks: groups follow the order, each cut to its size
    parts = blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    asks = asks.withColumn("r", (F.col("part") * r / parts).cast("int"))
    crowded = asks.groupBy("r").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > 2 * CELL_ASKS
    asks = asks.withColumn("r", group_of(r, "query_id")) if crowded else asks

    few = max(1, -(-blocks.count() // CELL_BOUNDS))
    sides = copied(blocks.select("part", "seq", "dims", "high", "low").withColumn("s", group_of(few, "part", "seq")), "r", r)
    needed = copied(asks, "s", few).groupBy("dims", "r", "s").cogroup(sides.groupBy("dims", "r", "s")).applyInPandas(_needed, "r int, part int, seq int")
    sent = blocks.select("part", "seq", "dims", "ids", "matrix", "high", "low").join(stored(needed), ["part", "seq"]).withColumn("s", group_of(s, "part", "seq"))
    found = copied(asks, "s", s).groupBy("dims", "r", "s").cogroup(sent.groupBy("dims", "r", "s")).applyInPandas(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
