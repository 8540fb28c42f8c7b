"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. A window is a fixed number of sequences and
is filled with the target token proportions: weights by source, or else each source's share
of what is queued, so that all queues end together. A queue that runs dry leaves its part of
the later windows to the others, by their weights, so that no sequence but the last is short.
Round by round each queue is due its quantum of what is still to fill, and its deficit from the
windows before; it gives whole tokens, and what is left of its due is its deficit in the next window
(`Course`). A task fills the windows of its own documents. The deficits that it starts with, after all the
windows of the tasks before, follow from queue lengths and weights alone (`Mixture.given`), so deficits are carried
from task to task without one task waiting for another.

Encoding is one pass over the documents, without a shuffle of texts. A task writes its ids
and its running position in each queue; the queue positions of whole tasks are sums over a
small table of (task, source). A queue is ordered by task, then by row. Of more than QUEUES
sources those with the most tokens have queues of their own, and the others share SHARED
queues by a hash; a shared queue is ordered by task, then by source, then by row.

Cases: a null source is a source of its own; null and empty text have only the end id; a
repeated row is packed again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.chunks import KEPT, encoder, vocabulary
from hirelens.llm.common import stored

SEQUENCE, WINDOW_SEQUENCES = 2048, 16
#: Beyond so many sources all but the QUEUES - 1 largest share queues (by a hash of the source), so that the table of queues stays small.
QUEUES, SHARED = 256, 32


def given(m: np.ndarray, lengths: list[int]) -> np.ndarray:
    """[queue, i]: tokens that each queue has given when all have given m[i] together.

    The first queue gives its share of m, rounded down; the rest is shared by the others in
    the same way. Each row rises with m, the rows add up to m, and at the end all is given.
    """
    rest, left, out = m, sum(lengths), []
    wide = left * left >= 1 << 63
    rest = rest.astype(object) if wide else rest
    for n in lengths:
        own = rest * n // max(left, 1)
        out.append(own)
        rest, left = rest - own, left - n
    return np.array(out, np.int64).reshape(len(lengths), len(m))


class Mixture:
    """Queues with lengths and weights: phases between the moments at which queues run dry, each with what its queues give in it."""

    def __init__(self, lengths: list[int], weights: list[float] | None = None):
        self.total = sum(lengths)
        weights = [float(n) for n in lengths] if weights is None else weights
        if len(weights) != len(lengths) or any(w < 0 or (w == 0 and n) for w, n in zip(weights, lengths, strict=True)):
            raise ValueError("every queue with tokens needs a positive weight")
        # at time t of its course a queue has given weight * t tokens, until it is dry
        dry = [n / w if n else 0.0 for n, w in zip(lengths, weights, strict=True)]
        if weights == [float(n) for n in lengths]:
            dry = [1.0 if n else 0.0 for n in lengths]
        before, self.starts, self.befores, self.parts = [0] * len(lengths), [], [], []
        for t in sorted({x for x in dry if x}):
            after = [n if d <= t else max(b, min(n, int(w * t))) for n, w, d, b in zip(lengths, weights, dry, before, strict=True)]
            self.starts.append(sum(before))
            self.befores.append(before)
            self.parts.append([a - b for a, b in zip(after, before, strict=True)])
            before = after

    def given(self, m: np.ndarray) -> np.ndarray:
        """[queue, i]: tokens that each queue has given when all have given m[i] together."""
        out = np.zeros((len(self.befores[0]) if self.befores else 0, len(m)), np.int64)
        phase = np.searchsorted(self.starts, m, "right") - 1
        for k in np.unique(phase).tolist():
            own = phase == k
            out[:, own] = np.array(self.befores[k], np.int64)[:, None] + given(m[own] - self.starts[k], self.parts[k])
        return out


class Course:
    """Windows filled one after another by deficit round-robin, from window `first` on."""

    def __init__(self, mix: Mixture, window: int, first: int):
        self.mix, self.window, self.first = mix, window, first
        self.at = min(first * window, mix.total)
        self.given = [mix.given(np.array([self.at]))[:, 0].tolist()]
        self._enter(max(int(np.searchsorted(mix.starts, self.at, "right")) - 1, 0))

    def _enter(self, phase: int) -> None:
        """The deficits at this moment of a phase: what each queue was due and could not give in whole tokens."""
        self.phase, self.deficits = phase, []
        if not self.mix.parts:
            return
        rest, left = self.at - self.mix.starts[phase], sum(self.mix.parts[phase])
        for n in self.mix.parts[phase]:
            own, deficit = divmod(rest * n, max(left, 1))
            self.deficits.append(deficit)
            rest, left = rest - own, left - n

    def _round(self, tokens: int, given: list[int]) -> None:
        """Fills so many tokens: each queue's quantum is its part of what is still to fill, its deficit is added and what is left over is kept."""
        parts = self.mix.parts[self.phase]
        rest, left = tokens, sum(parts)
        for q, n in enumerate(parts):
            own, self.deficits[q] = divmod(self.deficits[q] + rest * n, max(left, 1))
            given[q] += own
            rest, left = rest - own, left - n

    def _fill(self) -> None:
        given, end = list(self.given[-1]), min(self.at + self.window, self.mix.total)
        while self.at < end:
            turn = self.mix.starts[self.phase + 1] if self.phase + 1 < len(self.mix.starts) else self.mix.total
            stop = min(end, turn)
            self._round(stop - self.at, given)
            self.at = stop
            if stop == turn and self.phase + 1 < len(self.mix.starts):
                self._enter(self.phase + 1)
        self.given.append(given)

    def before(self, windows: np.ndarray) -> np.ndarray:
        """[queue, i]: tokens that each queue has given before window i of these, none of them before the first."""
        while len(self.given) <= int(windows.max(initial=self.first)) - self.first:
            self._fill()
        return np.array(self.given, np.int64)[windows - self.first].T


def window_of(queue: int, position: np.ndarray, mix: Mixture, window: int) -> np.ndarray:
    """The window that takes the token at each position of a queue: the last with given(start) <= position."""
    total = mix.total
    low, high = np.zeros(len(position), np.int64), np.full(len(position), -(-total // window), np.int64)
    while (high - low > 1).any():
        mid = (low + high) // 2
        early = mix.given(np.minimum(mid * window, total))[queue] <= position
        low, high = np.where(early, mid, low), np.where(early, high, mid)
    return low


def pieces(queue: int, start: np.ndarray, n: np.ndarray, mix: Mixture, sequence: int, window: int, courses: list[Course]) -> tuple[np.ndarray, ...]:
    """(document row, first id in it, ids, sequence, offset) of the pieces of documents that lie at `start` in a queue.

    courses: the windows that the task has filled so far, which the call goes on with.
    """
    first, last = window_of(queue, start, mix, window), window_of(queue, start + n - 1, mix, window)
    count = last - first + 1
    row = np.repeat(np.arange(len(start)), count)
    k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    if not courses or courses[0].first > k.min(initial=courses[0].first):
        courses[:] = [Course(mix, window, int(k.min(initial=first.min(initial=0))))]
    before, after = courses[0].before(k), courses[0].before(k + 1)
    low, high = np.maximum(before[queue], start[row]), np.minimum(after[queue], (start + n)[row])
    slot = k * window + (after - before)[:queue].sum(axis=0) + low - before[queue]
    keep = high > low
    row, low, high, slot = row[keep], low[keep], high[keep], slot[keep]
    parts = (slot + high - low - 1) // sequence - slot // sequence + 1  # cut at the ends of sequences
    r = np.repeat(np.arange(len(row)), parts)
    s = slot[r] // sequence + np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts)
    a, b = np.maximum(slot[r], s * sequence), np.minimum((slot + high - low)[r], (s + 1) * sequence)
    return row[r], low[r] + a - slot[r] - start[row[r]], b - a, s, a - s * sequence


def encode_documents(docs: DataFrame, end_id: int, path: str, kept: int = KEPT) -> DataFrame:
    """Stored: part, queue, before (in the part's queue), and the documents' columns doc_id, n, ids."""
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = encoder(path, kept).encode, TaskContext.get().partitionId()
        at: dict[str | None, int] = defaultdict(int)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = batch.slice(low, 512)
                ids = [of(text) + end for text in rows["text"].to_pylist()]
                before = []
                for source, x in zip(rows["source"].to_pylist(), ids, strict=True):
                    before.append(at[source])
                    at[source] += len(x) // 4
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), rows["source"], pa.array(before, pa.int64()), rows["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["part", "source", "before", "doc_id", "n", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return stored(narrow.mapInArrow(encode, "part int, source string, before long, doc_id long, n long, ids binary"))


def pack(docs: DataFrame, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, end_id: int = 1, path: str | None = None, target: dict[str | None, float] | None = None, temperature: float = 1.0, kept: int = KEPT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source of every piece.

    target: the share of each source in a window, as positive weights; sources that it doesn't name
    share the weight under "*" (1 if there is none) by their tokens. Without it, each queue's weight is its tokens to the power
    of temperature: 1 keeps the corpus's own shares, less gives small sources more of the first windows.
    kept: chunks that a Python worker keeps encoded; fewer take less memory and more time.
    """
    encoded = encode_documents(docs, end_id, path or vocabulary(), kept)
    sums = stored(encoded.groupBy("part", "source").agg(F.sum("n").alias("n")))
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES + 1).collect()
    named = set(target or ()) - {"*"}
    own = sorted(named | {r["source"] for r in (largest if len(largest) <= QUEUES else largest[: QUEUES - 1])}, key=lambda x: (x is not None, x))
    numbers = F.broadcast(encoded.sparkSession.createDataFrame([(x, k) for k, x in enumerate(own)], "own string, number int"))
    queue = F.when(F.col("number").isNull(), F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("int") + len(own)).otherwise(F.col("number"))
    queued = sums.join(numbers, F.col("source").eqNullSafe(F.col("own")), "left").select("part", "source", "n", queue.alias("queue"))
    # where a task's share of a queue begins, and within it each of the task's sources
    shares = queued.groupBy(F.col("part").alias("p"), F.col("queue").alias("q")).agg(F.sum("n").alias("m"))
    shares = shares.select("p", "q", (F.sum("m").over(Window.partitionBy("q").orderBy("p")) - F.col("m")).alias("share"))
    within = F.sum("n").over(Window.partitionBy("part", "queue").orderBy("source")) - F.col("n")
    placed = queued.select("part", "source", "n", "queue", within.alias("within")).join(shares, (F.col("part") == F.col("p")) & (F.col("queue") == F.col("q")))
    bases = stored(placed.select("part", "source", "n", "queue", (F.col("share") + F.col("within")).alias("base")))
    totals = {r["queue"]: r["n"] for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most QUEUES - 1 + SHARED rows
    lengths = [totals.get(k, 0) for k in range(max(totals, default=-1) + 1)]
    weights = None
    if target is not None:
        told = [target[own[k]] if k < len(own) and own[k] in named else None for k in range(len(lengths))]
        rest = sum(n for n, w in zip(lengths, told, strict=True) if w is None)
        weights = [w if w is not None else target.get("*", 1.0) * n / max(rest, 1) for n, w in zip(lengths, told, strict=True)]
    elif temperature != 1.0:
        weights = [float(n) ** temperature if n else 0.0 for n in lengths]
    mix = Mixture(lengths, weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        courses: list[Course] = []
        for batch in batches:
            queues = np.array(batch["queue"])
            start, n = np.array(batch["start"]), np.array(batch["n"])
            ids, docs_, names = batch["ids"], batch["doc_id"], batch["source"]
            for q in np.unique(queues).tolist():
                own = np.flatnonzero(queues == q)
                row, first, length, s, offset = pieces(q, start[own], n[own], mix, sequence, sequence * window_sequences, courses)
                row = own[row]
                views = {r: memoryview(ids[r].as_buffer()) for r in own.tolist()}
                crc = [zlib.crc32(views[r][4 * a : 4 * (a + k)]) for r, a, k in zip(row.tolist(), first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs_.take(pa.array(row)), pa.array(first), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(s), pa.array(offset), names.take(pa.array(row))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    same = F.col("e.source").eqNullSafe(F.col("b.source")) & (F.col("e.part") == F.col("b.part"))
    placed = encoded.alias("e").join(bases.alias("b"), same).select("doc_id", F.col("e.source").alias("source"), "queue", (F.col("base") + F.col("before")).alias("start"), F.col("e.n").alias("n"), "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
