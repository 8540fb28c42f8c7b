"""Token-id output with byte or bit planes.

Documents are dealt into ranges of doc_id, encoded once, and packed into shards of whole
documents. A shard holds its ids in blocks of a fixed number of ids. Each block is
transposed into byte planes (or bit planes), every plane is compressed with zstandard, and
a chunk index in front tells where each compressed plane lies. Shards are rows of a
Parquet table in the shared folder, so Spark's commit protocol covers lost executors.

Cases: null and empty text have only the end id; equal doc_ids are ordered by a hash of
their text; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.chunks import encoder, vocabulary
from hirelens.llm.common import stored

MAGIC = b"PLN1"
_HEAD = struct.Struct("<4sBIQQQ")  # magic, planes of an id (4 bytes or 32 bits), ids a block, documents, ids, bytes of the index
BLOCK_IDS, SHARD_IDS = 1 << 14, 1 << 20


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == 4:
        return [row.tobytes() for row in octets]
    return [np.packbits(octets[k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(rows: list[bytes], n: int, planes: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, row in enumerate(rows):
        raw = np.frombuffer(row, np.uint8)
        if planes == 4:
            out[:, k] = raw
        else:
            out[:, k // 8] |= np.unpackbits(raw, count=n) << np.uint8(k % 8)
    return out.view("<u4").reshape(-1)


def write_shard(counts: list[int], ids: bytes, planes: int = 4, block: int = BLOCK_IDS) -> bytes:
    """One shard: head, chunk index (documents' id counts, planes' compressed lengths), then the planes."""
    pack = zstandard.ZstdCompressor(level=3).compress
    array = np.frombuffer(ids, "<u4")
    chunks = [pack(p) for at in range(0, len(array), block) for p in to_planes(array[at : at + block], planes)]
    index = pack(np.array(counts, "<u8").tobytes() + np.array([len(c) for c in chunks], "<u4").tobytes())
    return b"".join([_HEAD.pack(MAGIC, planes, block, len(counts), len(array), len(index)), index, *chunks])


def read_shard(data: bytes) -> tuple[np.ndarray, bytes]:
    """(ids of each document, all ids as little-endian 32-bit integers)."""
    magic, planes, block, n_docs, n_ids, n_index = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a plane shard")
    unpack = zstandard.ZstdDecompressor().decompress
    at = _HEAD.size + n_index
    index = unpack(data[_HEAD.size : at])
    counts = np.frombuffer(index, "<u8", n_docs)
    lengths = np.frombuffer(index, "<u4", offset=8 * n_docs).reshape(-1, planes)
    out = []
    for k, row in enumerate(lengths):
        rows = []
        for length in row.tolist():
            rows.append(unpack(data[at : at + length]))
            at += length
        out.append(from_planes(rows, min(block, n_ids - k * block), planes))
    return counts, b"".join(x.tobytes() for x in out)


def write_ids(docs: DataFrame, end_id: int, path: str | None = None, planes: int = 4) -> DataFrame:
    """The stored shards: part, shard, ids_before (in the part), n_ids, doc_ids, data."""
    path = path or vocabulary()
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        shard, before, size = 0, 0, 0
        names: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            row = ([part], [shard], [before], [size], pa.array([names], pa.list_(pa.int64())), pa.array([write_shard(counts, b"".join(held), planes)], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in row], ["part", "shard", "ids_before", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                if size and size + n > SHARD_IDS:
                    yield close()
                    shard, before, size, names, counts, held = shard + 1, before + size, 0, [], [], []
                names.append(doc)
                counts.append(n)
                held.append(ids)
                size += n
        if counts:
            yield close()

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(write, "part long, shard long, ids_before long, n_ids long, doc_ids array<long>, data binary"), "uncompressed")


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the stored shards."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))  # a row for each writing task
    bases = totals.select("part", (F.sum("ids_of_part").over(Window.orderBy("part")) - F.col("ids_of_part")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, names, data in zip(batch["base"].to_pylist(), batch["doc_ids"], batch["data"], strict=True):
                counts, ids = read_shard(data.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts.astype(np.int64)
                view = memoryview(ids)
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(starts + base), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.join(bases, "part").select((F.col("base") + F.col("ids_before")).alias("base"), "doc_ids", "data")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, end_id: int = 2, path: str | None = None, planes: int = 4) -> DataFrame:
    return read_ids(write_ids(docs, end_id, path, planes))
