"""Shared helpers: the shared folder, hashing rules, and blocks of code points for n-gram work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import shared_dir

#: Words are runs of anything but ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column) -> Column:
    """crc32 of doc_id as text, modulo 5; 0 marks the held-out fold. A null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def words_of(text: str | Column) -> Column:
    """The array of words; null or blank text gives an empty array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANKS), lambda w: w != "")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def char_blocks(texts: list[str], longest: int, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, text number of each) in blocks of at most about `block` characters.

    Texts are set apart by longest - 1 zeros; a text longer than a block comes in slices
    that overlap by longest - 1, so that every n-gram up to `longest` lies in one block
    (shorter ones at an overlap must be counted by their last character, see ngram_hashes).
    """
    gap = np.zeros(longest - 1, np.uint32)
    parts: list[np.ndarray] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        codes = code_points(text)
        for at in range(0, max(len(codes), 1), block):
            piece = codes[max(0, at - (longest - 1)) : at + block]
            if at == 0:
                piece = np.concatenate([gap, piece])
            parts.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= block:
                yield np.concatenate(parts), np.repeat(np.array(owner), [len(p) for p in parts])
                parts, owner, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.repeat(np.array(owner), [len(p) for p in parts])


def ngram_hashes(codes: np.ndarray, owner: np.ndarray, n: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams that end in a block, and the text number of each.

    Each slice starts with longest - 1 characters of context (or zeros), so an n-gram is
    taken where its last character is not context; grams that hold a zero are left out.
    """
    with np.errstate(over="ignore"):
        m = len(codes) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        full = np.ones(m, bool)
        for k in range(n):
            c = codes[k : k + m]
            h = (h ^ c) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            full &= c != 0
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - bits)
    last = np.arange(n - 1, len(codes))
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    first = np.zeros(len(codes), np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    full &= (last - first[last]) >= longest - 1
    return h[full].astype(np.int64), owner[last[full]]
