"""Hard negatives by segment summary filtering.

Each vector is stored with the mean and the deviation of SEGMENTS runs of its components. For two
vectors, a segment's part of the inner product is the product of the means plus or minus the product of
the deviations (each times the segment's length), so summaries bound the score from both sides. Bounds
start with one segment, are refined with more and more, and only pairs that still qualify are scored on
their components. What qualifies follows from the bounds alone: the k-th largest lower bound among pairs
that surely count is a score that the k-th best reaches.

An anchor's positives are its best rows of the same label; a negative of a positive is a row of another
label with low * positive <= 100 * score <= high * positive. Anchors and rows meet on a grid of bounded
cells, every anchor with every row, and each cell hands on at most `positives` or `negatives` rows per ask.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of
other lengths do not meet; rows that repeat an id are rows of their own, but a row with an anchor's own id is
neither its positive nor its negative, and of anchors that repeat an id the one with the least (label, vector bytes) stands; ties
go to the smaller id; a positive score of zero or less leaves no negatives, but for zero itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import stored
from hirelens.llm.vectors import copied, group_of, packed, product, totals

#: Segments of the stored summaries, and of the coarser ones before them.
SEGMENTS, LADDER = 16, (1, 4)
SUMMARY = ", means binary, deviations binary"
ASK = "anchor_id long, label long, dims int, vector binary"
EVERY = (-(1 << 63), (1 << 63) - 1)


def edges(dims: int, segments: int) -> np.ndarray:
    n = min(segments, dims)
    return np.arange(n + 1) * dims // max(n, 1)


def summarised(x: np.ndarray) -> list[np.ndarray]:
    """Mean and deviation of each segment of each row."""
    at = edges(x.shape[1], SEGMENTS)
    if len(at) < 2:
        return [np.zeros((len(x), 0))] * 2
    length = np.diff(at)
    mean = np.add.reduceat(x, at[:-1], axis=1) / length
    rest = (x - np.repeat(mean, length, axis=1)) ** 2
    return [mean, np.sqrt(np.add.reduceat(rest, at[:-1], axis=1) / length)]


class Summaries:
    """Bounds of inner products between rows, by coarser and finer segments."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, dims: int) -> None:
        length = np.diff(edges(dims, SEGMENTS)).astype(np.float64)
        sums, squares = mean * length, (deviation**2 + mean**2) * length
        self.levels = []
        for n in (*LADDER, len(length)):
            at = edges(len(length), n)[:-1]
            weight = np.add.reduceat(length, at)
            centre = np.add.reduceat(sums, at, axis=1) / np.sqrt(weight)
            spread = np.sqrt(np.maximum(np.add.reduceat(squares, at, axis=1) - centre**2, 0))
            self.levels.append((centre, spread))
        self.norm = np.sqrt(squares.sum(axis=1))

    def bounds(self, level: int, other: "Summaries", k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) for row k of other against these rows, a little wider than rounding needs."""
        (centre, spread), (c, s) = self.levels[level], other.levels[level]
        middle, wide = centre[rows] @ c[k], spread[rows] @ s[k]
        wide += 1e-7 * self.norm[rows] * other.norm[k] + 1e-6
        return middle - wide, middle + wide


def best(sums: Summaries, asks: Summaries, k: int, rows: np.ndarray, exact, wanted: int, bands: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of all that can be among the `wanted` best of a band (least, most) of scores."""
    for level in range(len(sums.levels)):
        if len(rows) <= wanted:
            break
        lower, upper = sums.bounds(level, asks, k, rows)
        open_ = np.zeros(len(rows), bool)
        for low, high in bands:
            sure = lower[(upper <= high) & (lower >= low)]
            floor = max(low, np.partition(sure, len(sure) - wanted)[len(sure) - wanted]) if len(sure) >= wanted else low
            open_ |= (upper >= floor) & (lower <= high)
        rows = rows[open_]
    return rows, exact(k, rows)


class Cell:
    """A cell's rows and asking rows."""

    def __init__(self, asks: pd.DataFrame, blocks: pd.DataFrame, dims: int) -> None:
        joined = lambda c, kind: np.frombuffer(b"".join(blocks[c]), kind)
        self.ids, self.labels = joined("ids", np.int64), joined("labels", np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(b"".join(blocks.matrix), np.int32).reshape(n, dims)
        width = len(edges(dims, SEGMENTS)) - 1 if dims else 0
        self.q = np.frombuffer(b"".join(asks.vector), np.int32).astype(np.int64).reshape(len(asks), dims)
        if dims:
            self.sums = Summaries(joined("means", np.float64).reshape(n, width), joined("deviations", np.float64).reshape(n, width), dims)
            self.asks = Summaries(*summarised(self.q), dims)
        self.dims = dims

    def exact(self, k: int, rows: np.ndarray) -> np.ndarray:
        return product(self.x[rows].astype(np.int64), self.q[k : k + 1])[:, 0]

    def best(self, k: int, rows: np.ndarray, wanted: int, bands: list[tuple[int, int]] = [EVERY]) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: B006  never changed
        """(ids, scores) of the `wanted` best rows in each band, best first."""
        rows, scores = best(self.sums, self.asks, k, rows, self.exact, wanted, bands) if self.dims else (rows, np.zeros(len(rows), np.int64))
        for low, high in bands:
            own = np.flatnonzero((scores >= low) & (scores <= high))
            own = own[np.lexsort((self.ids[rows[own]], -scores[own]))[:wanted]]
            yield self.ids[rows[own]], scores[own]


def _table(out: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([np.zeros(0, np.int64), *(x[c] for x in out)]) for c in columns})


def _positives(wanted: int):
    def cell(key: tuple, asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        if len(asks) and len(blocks):
            c = Cell(asks, blocks, int(key[0]))
            by_label = {v: np.flatnonzero(c.labels == v) for v in asks.label.unique()}
            for k, (own, label) in enumerate(zip(asks.anchor_id, asks.label, strict=True)):
                rows = by_label[label]
                for ids, scores in c.best(k, rows[c.ids[rows] != own], wanted):
                    out.append({"anchor_id": np.full(len(ids), own), "positive_id": ids, "positive_score": scores})
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    return cell


def _band(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(wanted: int, low: int, high: int):
    def cell(key: tuple, asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        if len(asks) and len(blocks):
            c = Cell(asks, blocks, int(key[0]))
            other = {v: np.flatnonzero(c.labels != v) for v in asks.label.unique()}
            for k, (own, label, scores) in enumerate(zip(asks.anchor_id, asks.label, asks.scores, strict=True)):
                rows = other[label]
                asked = {int(score): _band(int(score), low, high) for score in scores}
                asked = {score: band for score, band in asked.items() if band[0] <= band[1]}
                for score, (ids, found) in zip(asked, c.best(k, rows[c.ids[rows] != own], wanted, list(asked.values())) if asked else [], strict=True):
                    out.append({"anchor_id": np.full(len(ids), own), "positive_score": np.full(len(ids), score), "negative_id": ids, "negative_score": found})
        return _table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return cell


def _asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for b in frame.itertuples():
            rows = np.flatnonzero(np.frombuffer(b.asks, bool))
            x = np.frombuffer(b.matrix, np.int32).reshape(b.n, b.dims)
            ids, labels = np.frombuffer(b.ids, np.int64), np.frombuffer(b.labels, np.int64)
            yield pd.DataFrame({"anchor_id": ids[rows], "label": labels[rows], "dims": np.int32(b.dims), "vector": [x[r].tobytes() for r in rows]})


def mine(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank."""
    label = F.col(label) if isinstance(label, str) else label
    source = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"), label.alias("label"), anchors.alias("asks"))
    blocks = stored(packed(source, scale, summarised, SUMMARY))
    asks = blocks.where("n > 0").select("dims", "n", "ids", "labels", "asks", "matrix").mapInPandas(_asking, ASK)
    asks = stored(asks.groupBy("anchor_id").agg(F.min(F.struct("label", "vector", "dims")).alias("a")).select("anchor_id", "a.*"))
    r, s = totals(blocks, asks)
    keys = ["dims", "r", "s"]
    placed = copied(blocks.withColumn("s", group_of(s, "part", "seq")), "r", r).groupBy(*keys)
    meet = lambda own: copied(own.withColumn("r", group_of(r, "anchor_id")), "s", s).groupBy(*keys).cogroup(placed)

    near = meet(asks).applyInPandas(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = stored(near.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives))

    wanted = asks.join(near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores")), "anchor_id")  # at most `positives` scores an anchor
    found = stored(meet(wanted).applyInPandas(_negatives(negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long"))
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
