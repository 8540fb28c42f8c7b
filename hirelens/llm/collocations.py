"""Phrase collocation mining by dynamic itemset counting.

The corpus falls into `shards` shards, which are scanned in a cycle. Words are counted from the first scan.
Once a word has been seen `least` times, phrases of two such words are counted from the next scan on,
and phrases of three once both of their two-word parts have been seen that often; each is counted for one
full cycle from there, so that its count is exact whichever scan it began in. Scans end when
the last phrase has completed its cycle: three cycles at most.

Which phrases are active is kept in tables of a fixed size, one cell a hash, holding the scan after which
the first phrase of the cell was seen often enough. Phrases that share a cell become active together, which
makes more to count and no count wrong. Counts are keyed by language and phrase and combine before they
are shuffled; a phrase that has completed its cycle and was not seen often enough is dropped.

Rows, by (language, phrase of 2 or 3 words seen `least` times): of the ways to cut the phrase the one with
the lowest score floor(1000000 a a / (l r)), ties to the smallest k, where a, l and r count the phrase and its
parts; phrases within a longer candidate with at least half as many occurrences go; the best `top`
of each language stay, by score, count, then bytes of the phrase.

Cases: null text is empty; a null language is `und`; texts of blanks and separators have no words; rows that
repeat count each time; ties as above; a language without a candidate has no rows; an empty table gives none;
the whole of a text is counted, however long, and no phrase spans two pieces or two texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelens.llm.common import stored

SHARDS, CELL_BITS = 2, 24
#: Bytes of text that a task counts at a time; rows and bytes of phrases up to which their counts are broadcast.
CHUNK, BROADCAST_ROWS, BROADCAST_BYTES = 1 << 23, 200_000, 1 << 24
NEVER, BATCH = 255, 1 << 17
#: kind: the words of a phrase (0: all words of a language), the scan from which it is counted (from bit 8), its cell (from bit 16).
COUNTS = "lang string, phrase string, kind long, c long"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("kind", pa.int64()), ("c", pa.int64())])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BLANK, END = 0x20, 0x0A


def _byte_table() -> np.ndarray:
    """Each byte as words see it: A-Z small, tab a blank, every separator a line feed."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[0x09] = BLANK
    table[0x0A:0x0E] = END
    table[list(b".,;:!?")] = END
    return table


_BYTES = _byte_table()


def _joined(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h * _MIX[0]) ^ (other + (h >> np.uint64(29)))
        return (x ^ (x >> np.uint64(32))) * _MIX[1]


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _numbered(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct codes, the number of each code among them); codes lie below `most`."""
    if most > 1 << 24:
        return np.unique(codes, return_inverse=True)
    there = np.zeros(most, bool)
    there[codes] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[codes]


def _distinct(columns: list[np.ndarray], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of these columns of numbers below `words`, and the count of each."""
    code, pairs = columns[0].astype(np.int64), None
    for k, c in enumerate(columns[1:], 2):
        if words**k >= 1 << 63:
            pairs, code = np.unique(code, return_inverse=True)
        code = code * words + c
    code, count = np.unique(code.astype(np.uint32) if words ** len(columns) < 1 << 32 else code, return_counts=True)
    code, out = code.astype(np.int64), []
    for k in range(len(columns), 1, -1):
        code, last = code // words, code % words
        code = pairs[code] if pairs is not None and words**k >= 1 << 63 else code
        out.append(last)
    return [code, *out[::-1]], count


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds CHUNK bytes of text, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words; of each word in order: its number, whether the next one follows in the same piece, and its text)."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    data = _BYTES[data]
    filled = (data != BLANK) & (data != END)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets - offsets[0]] = True  # a text begins here
    starts = np.flatnonzero(filled & (fresh[:-1] | np.r_[True, ~filled[:-1]]))
    stops = np.flatnonzero(filled & (fresh[1:] | np.r_[~filled[1:], True]))
    ends = np.concatenate([[0], np.cumsum(stops - starts + 1)])
    text = np.searchsorted(offsets - offsets[0], starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(data == END), starts)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[filled])])
    encoded = words.dictionary_encode()
    return encoded.dictionary.cast(pa.string()), encoded.indices.to_numpy(zero_copy_only=False), (np.diff(piece) == 0) & (np.diff(text) == 0), text.astype(np.int32)


def _counted(chunk: pa.RecordBatch, step: int, shards: int, bits: int, seen_words: np.ndarray, seen_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is active at this step, with its counts in the chunk."""
    names, number, follows, owner = words_of(chunk.column("text"))
    if not len(number):
        return
    langs = chunk.column("lang").dictionary_encode()
    lang_of = langs.indices.to_numpy(zero_copy_only=False)[owner]
    del owner
    kinds, word = _numbered(lang_of.astype(np.int64) * len(names) + number, len(langs.dictionary) * len(names))  # words by language
    kind_lang, kind_text, word = kinds // len(names), kinds % len(names), word.astype(np.int32)
    del number
    hashed = lambda a: pd.util.hash_array(np.array(a.to_pylist(), object), categorize=False)
    hashes = _joined(hashed(langs.dictionary)[kind_lang], hashed(names)[kind_text])

    def rows(words: list[np.ndarray], start: np.ndarray, cell: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        parts = [names.take(pa.array(kind_text[w])) for w in words]
        phrase = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        kind = len(words) | start.astype(np.int64) << 8 | cell.astype(np.int64) << 16
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(kind_lang[words[0]])), phrase, pa.array(kind), pa.array(count)], schema=_ARROW)

    if step < shards:
        own, count = np.arange(len(kinds)), np.bincount(word, minlength=len(kinds))
        yield rows([own], np.zeros(len(own)), _cells(hashes, bits), count)
        each, total = np.unique(lang_of, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(each)), pa.array([""] * len(each)), pa.array(np.zeros(len(each), np.int64)), pa.array(total)], schema=_ARROW)
    del lang_of

    def due(after: np.ndarray) -> np.ndarray:
        """Of phrases whose parts were seen often enough after these steps: are they within their cycle now?"""
        return (after < step) & (step <= after.astype(np.int16) + shards) & (after != NEVER)

    def pair_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _cells(_joined(hashes[a], hashes[b]), bits)

    reach = seen_words[_cells(hashes, bits)]
    at = np.flatnonzero(follows & due(np.maximum(reach[word[:-1]], reach[word[1:]])))
    (a, b), count = _distinct([word[at], word[at + 1]], len(kinds))
    yield rows([a, b], np.maximum(reach[a], reach[b]).astype(np.int64) + 1, pair_cells(a, b), count)

    if (seen_pairs != NEVER).any():
        pair = np.full(len(word), NEVER, np.uint8)  # the step of the pair that begins at a word; none across pieces
        at = np.flatnonzero(follows)
        pair[at] = seen_pairs[pair_cells(word[at], word[at + 1])]
        at = np.flatnonzero(due(np.maximum(pair[:-1], pair[1:])))
        (a, b, c), count = _distinct([word[at], word[at + 1], word[at + 2]], len(kinds))
        yield rows([a, b, c], np.maximum(seen_pairs[pair_cells(a, b)], seen_pairs[pair_cells(b, c)]).astype(np.int64) + 1, np.zeros(len(a)), count)


def phrase_counts(docs: DataFrame, least: int = 10, shards: int = SHARDS, bits: int = CELL_BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, size, a: the words and the phrases of 2 and 3 words that occur `least` times; size 0: all words of a language."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias("_id") for c in ("doc_id",) if c in docs.columns])
    corpus = own.withColumn("shard", F.pmod(F.xxhash64(*own.columns), F.lit(shards)))
    seen = {size: np.full(1 << bits, NEVER, np.uint8) for size in (1, 2)}
    total: DataFrame | None = None
    step, last = 0, shards - 1
    while step <= last:
        tables = spark.sparkContext.broadcast([zlib.compress(seen[size].tobytes(), 1) for size in (1, 2)])

        def scan(batches: Iterator[pa.RecordBatch], step=step, tables=tables) -> Iterator[pa.RecordBatch]:
            own = [np.frombuffer(zlib.decompress(t), np.uint8) for t in tables.value]
            for chunk in _chunks(batches):
                for b in _counted(chunk, step, shards, bits, *own):
                    yield from (b.slice(at, BATCH) for at in range(0, b.num_rows, BATCH))

        new = corpus.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(scan, COUNTS)
        rows = new if total is None else total.unionByName(new)
        rows = rows.groupBy("lang", "phrase").agg(F.max("kind").alias("kind"), F.sum("c").alias("c"))  # a phrase has one kind
        size, start, cell = F.col("kind").bitwiseAND(255), F.shiftright("kind", 8).bitwiseAND(255), F.shiftright("kind", 16)
        going = start + shards - 1 > step
        total = stored(rows.where((F.col("c") >= least) | (size == 0) | going))
        tables.destroy()  # this step's counts are stored
        number = cell + 1
        often = total.where((F.col("c") >= least) & size.isin(1, 2)).groupBy(size.alias("size"), F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("cells"))
        for r in often.toLocalIterator():  # 2^bits bits for each size at most
            at = (r["bucket"] - 1 << 15) + np.flatnonzero(np.unpackbits(np.frombuffer(r["cells"], np.uint8), bitorder="little"))
            at = at[seen[r["size"]][at] == NEVER]
            seen[r["size"]][at] = step
            if len(at):
                last = max(last, step + shards)
        step += 1
    return total.where((F.col("c") >= least) | (size == 0)).select("lang", "phrase", size.cast("int").alias("size"), F.col("c").alias("a"))


def _sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small in rows and bytes; else joined by a shuffle."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("part") + F.octet_length("lang")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, contained: int = 50, shards: int = SHARDS, bits: int = CELL_BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, least, shards, bits, text, lang)
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    word = lambda k: F.element_at("w", k)
    pair = lambda k: F.concat_ws(" ", word(k), word(k + 1))
    cut = lambda k, x, y: F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y"))
    cuts = F.when(F.col("size") == 2, F.array(cut(1, word(1), word(2)))).otherwise(F.array(cut(1, word(1), pair(2)), cut(2, pair(1), word(3))))
    parts = _sized(counts.where(F.col("size").isin(1, 2)).select(F.col("lang"), F.col("phrase").alias("part"), F.col("a").alias("f")))
    side = lambda own, name: parts.select("lang", F.col("part").alias(own), F.col("f").alias(name))
    rows = phrases.select("lang", "phrase", "a", F.inline(cuts)).join(side("x", "l"), ["lang", "x"]).join(side("y", "r"), ["lang", "y"])
    rows = rows.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(20,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = rows.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    within = phrases.where("size = 3").select("lang", F.explode(F.array(pair(1), pair(2))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    # ranks by ranges and prefix counts: no task holds a whole language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranged = stored(kept.repartitionByRange("lang", *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("lang", "part").agg(F.count("*").alias("own"))
    starts = parts.withColumn("before", F.sum("own").over(Window.partitionBy("lang").orderBy("part")) - F.col("own")).where(F.col("before") < top)
    placed = ranged.join(F.broadcast(starts.select("lang", "part", "before")) if parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else starts, ["lang", "part"])
    ranked = placed.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
