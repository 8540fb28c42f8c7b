"""Vectors as whole numbers, packed in blocks of rows, and the grid on which a set of asking rows meets all rows.

A component x becomes floor(scale * x), x as double. Products are exact: in float64 where no sum can
pass 2^53, else in 64-bit integers. A component beyond 32 bits, or a sum that could pass 64 bits, is an error, never a wrapped number.

Cases: rows with a null id, a null vector, a null or non-finite component (or a null label, where there
is one) take no part; vectors meet only vectors of their own length; an empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in a block; rows and asking rows in a cell of the grid.
BLOCK, CELL_ROWS, CELL_ASKS = 1024, 1 << 16, 1 << 14
BLOCKS = "part int, seq int, dims int, n int, ids binary, labels binary, asks binary, matrix binary"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and b, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("an inner product may pass 64 bits: take a smaller scale")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _quantised(batch: pa.RecordBatch, scale: int) -> Iterator[tuple]:
    """(dims, ids, labels, asks, matrix) of the rows that take part, by length of vector."""
    for name in ("id", "vector", "label"):
        batch = batch.filter(batch.column(name).is_valid())
    vector = batch.column("vector")
    lengths = vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
    whole = np.bincount(np.repeat(np.arange(len(lengths)), lengths), ~np.isfinite(x), len(lengths)) == 0
    starts = np.cumsum(lengths) - lengths
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "asks")]
    for dims in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == dims))
        q = np.floor(scale * x[starts[rows][:, None] + np.arange(dims)])
        if q.size and np.abs(q).max() >= 1 << 31:
            raise ValueError("a scaled component passes 32 bits: take a smaller scale")
        yield int(dims), *(c[rows] for c in columns), q.astype(np.int32)


def packed(rows: DataFrame, scale: int, more: Callable[[np.ndarray], list[np.ndarray]] | None = None, schema: str = "", size: int = BLOCK) -> DataFrame:
    """Blocks of up to `size` rows, in the order of the input's partitions; to be stored, since part and seq name them.

    rows: id long, vector, label long, asks boolean. more(matrix): further arrays of a block, kept as the binary columns in schema.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in full.fields]
        kinds = {"int": pa.int32(), "binary": pa.binary()}
        arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in full.fields])
        held: dict[int, list[tuple]] = {}
        part, seq = TaskContext.get().partitionId(), 0

        def flush(dims: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            ids, labels, asks, x = (np.concatenate(c) for c in zip(*held.pop(dims), strict=True))
            at = 0
            while len(ids) - at >= least:
                own = slice(at, at + size)
                block = x[own]
                row = [part, seq, dims, len(block), ids[own].astype(np.int64).tobytes(), labels[own].astype(np.int64).tobytes(), asks[own].astype(bool).tobytes(), block.tobytes()]
                row += [a.tobytes() for a in (more(block.astype(np.int64)) if more else [])]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=arrow)
                at, seq = at + size, seq + 1
            if at < len(ids):
                held[dims] = [(ids[at:], labels[at:], asks[at:], x[at:])]

        for batch in batches:
            for dims, *columns in _quantised(batch, scale):
                held.setdefault(dims, []).append(tuple(columns))
                if sum(len(c[0]) for c in held[dims]) >= size:
                    yield from flush(dims, size)
        for dims in list(held):
            yield from flush(dims, 1)

    full = StructType.fromDDL(BLOCKS + schema)
    return rows.select(F.col("id").cast("long"), "vector", F.col("label").cast("long"), F.coalesce("asks", F.lit(False)).alias("asks")).mapInArrow(pack, full)


def cells(asks: int, rows: int, parts: int) -> tuple[int, int]:
    """How many groups of asking rows and of rows the grid has: as many as memory needs, and of rows no fewer than there are cores to use."""
    return -(-max(asks, 1) // CELL_ASKS), max(-(-max(rows, 1) // CELL_ROWS), parts)


def totals(blocks: DataFrame, asking: DataFrame) -> tuple[int, int]:
    """Groups of the grid for these blocks and these asking rows."""
    n, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return cells(asking.count(), n, min(count, 4 * blocks.sparkSession.sparkContext.defaultParallelism))


def group_of(groups: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def copied(df: DataFrame, name: str, groups: int) -> DataFrame:
    """A copy of each row for each group of the other side."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
