"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct 4-word shingles as 64-bit hashes. Documents with equal
sets are folded into one. Similar documents are put into groups of about GROUP members (and
at most about GROUP_TOKENS tokens); the matrix says which groups have which tokens. Where it
is spread over tasks only the tokens are kept that a match needs: under one order of all
tokens, two sets with a Jaccard similarity of 0.85 share m of their first
n - ceil(0.85 n) + m tokens. The order puts tokens that many documents have last, so that a
passage which thousands of documents share pairs none of them up. Which tokens are common is
counted in CELLS hash cells over all documents, a table of fixed size; the order steers the
work, not the result.

Groups are opened in two steps. First each group by itself: groups are formed by the commonest
of the kept tokens, so that near copies meet in one group; where a token has many documents
they are split by a hash, and the least of them joins every part, so that what is like it is
linked through it. Then groups of different components: what the first step has linked is one
group of the matrix, however large, and is never compared with itself again. Pairs of groups
that share enough kept tokens qualify; only members that share enough of them are shipped, in
blocks, and every member is first held against the other block's token union, since no member
can overlap it in more. What is left is compared exactly.

Cases: null, empty and blank texts have no shingles and link with nothing; equal texts link;
a null doc_id links with nothing and has a null component; rows that repeat a doc_id are
documents of their own, each with the class of its set, and share a class where the id is
the smallest of both sets; an empty table gives no rows; other columns are ignored, and
carried by `one_of_each`, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import stored
from hirelens.llm.components import components

SHINGLE, PERCENT, GROUP, CELL_BITS, BLOCK_BITS = 4, 85, 64, 20, 12
#: Tokens of a group that are opened together, and columns of a matrix that is multiplied at once.
GROUP_TOKENS, COLUMNS = 1 << 20, 1 << 16
#: A set of n tokens has n // SHARED_PART tokens more in its prefix, and must share as many more.
SHARED_PART = 20
#: Ids of documents whose groups are opened are broadcast up to so many; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_KEPT = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its size allows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles: A-Z lower-cased, words split at ASCII blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    m = len(w) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(m, width, np.uint64)
        for k in range(width):
            h = (h ^ w[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _signature(tokens: bytes) -> bytes:
    return hashlib.blake2b(tokens, digest_size=16).digest()


def least_shared(n: int) -> int:
    """Prefix tokens that a set of n tokens shares with every set that it links with of at least this many."""
    return 1 + n // SHARED_PART


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + least_shared(n))


def common_cells(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Which of the 2^CELL_BITS hash cells of tokens hold a common token: a bit each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                parts = [shingles(t, size) for t in batch["text"].slice(low, 256).to_pylist()]
                cells += np.bincount((np.concatenate(parts) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.int32)
        blocks = cells.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in used.tolist()], pa.binary())], ["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block long, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(F.col("block")).mapInArrow(total, schema).collect()  # 2^(CELL_BITS - BLOCK_BITS) rows
    cells = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for r in rows:
        cells[r["block"]] = np.frombuffer(r["counts"], np.int64)
    mean = cells.mean()
    return np.packbits(cells.reshape(-1) > mean + 6 * np.sqrt(mean) + 32)


def document_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Stored: doc_id, n_shingles, signature of the set, prefix (its first tokens in the order)."""
    shared = docs.sparkSession.sparkContext.broadcast(common_cells(docs, size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                n, signature, prefix = [], [], []
                for text in part["text"].to_pylist():
                    h = shingles(text, size)
                    late = common[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    order = np.concatenate([h[~late], h[late]])
                    n.append(len(h))
                    signature.append(_signature(h.tobytes()))
                    prefix.append(order[: prefix_length(len(h), percent)].view(np.int64) if len(h) else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))], ["doc_id", "n_shingles", "signature", "prefix"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(narrow.mapInArrow(sets, "doc_id long, n_shingles long, signature binary, prefix array<long>"))


def _links(ids_a: np.ndarray, sets_a: list[np.ndarray], ids_b: np.ndarray, sets_b: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of two groups, after the bound by the other group's token union."""

    def bounded(sets: list[np.ndarray], union: np.ndarray) -> list[int]:
        sizes = [len(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), sizes)
        tokens = np.concatenate(sets)
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        overlap = np.bincount(owner, union[at] == tokens, len(sets))
        return [k for k, n in enumerate(sizes) if 100 * overlap[k] >= percent * n]

    left = bounded(sets_a, np.unique(np.concatenate(sets_b)))
    if not left:
        return []
    right = bounded(sets_b, np.unique(np.concatenate([sets_a[k] for k in left])))
    if not right:
        return []
    a, b = [sets_a[k] for k in left], [sets_b[k] for k in right]
    vocabulary = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))

    def matrix(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(own)), np.float32)
        for k, s in enumerate(sets):
            s = s[np.searchsorted(s, own[0]) : np.searchsorted(s, own[-1], "right")]
            at = np.searchsorted(own, s)
            out[k, at[own[at] == s]] = 1
        return out

    shared = np.zeros((len(a), len(b)))
    for low in range(0, len(vocabulary), COLUMNS):
        own = vocabulary[low : low + COLUMNS]
        shared += matrix(a, own) @ matrix(b, own).T
    sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    i, j = np.nonzero(100 * shared >= percent * (sizes - shared))
    return [(int(ids_a[left[x]]), int(ids_b[right[y]])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]


def _record(ids: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """A group as its ids, its token union, and a row of bits over the union for each member."""
    union = np.unique(np.concatenate(sets))
    bits = np.zeros((len(sets), len(union)), bool)
    for k, s in enumerate(sets):
        bits[k, np.searchsorted(union, s)] = True
    return zlib.compress(np.array([len(sets), len(union)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + union.tobytes() + np.packbits(bits, axis=1).tobytes(), 1)


def _members(record: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zlib.decompress(record)
    n, width = np.frombuffer(raw, np.int64, 2).tolist()
    ids, union = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.uint64, width, 16 + 8 * n)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 + 8 * (n + width)).reshape(n, -1), axis=1, count=width).view(bool)
    return ids, [union[row] for row in bits]


def _spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest with the same components as the links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _parts(rows: DataFrame, key: str, group: int) -> DataFrame:
    """(key, parts, leader) of keys with too much for one group; a row for each GROUP members at least."""
    parts = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int").alias("parts")
    return rows.groupBy(key).agg(parts, F.min("rep").alias("leader")).where("parts > 1")


def similar_pairs(docs: DataFrame, sets: DataFrame, size: int = SHINGLE, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """(a, b): links between documents with different sets, enough of them to connect what is linked."""
    reps = stored(sets.where("n_shingles > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("rep")))
    own = sets.join(bounded(reps.select(F.col("signature").alias("s"), "rep")), (F.col("signature") == F.col("s")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    every = own.select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), F.explode("prefix").alias("token"))
    posts = stored(every.repartition("token").withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1"))
    enough = lambda n: 1 + F.floor(n / SHARED_PART)  # noqa: E731  see least_shared
    able = lambda shared: shared >= enough(F.col("n") * percent / 100)

    # groups: by the commonest shared token, split by a hash where it has much; its least document joins every part
    keys = stored(posts.groupBy("rep").agg(F.max(F.struct("c", "token")).alias("k"), F.max("n").alias("n")).select("rep", "n", F.col("k.token").alias("key")))
    large = stored(_parts(keys, "key", group))
    gid = lambda part: F.xxhash64("key", part).alias("gid")
    placed = keys.join(bounded(large), "key", "left").select("rep", "n", gid(F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))))
    groups = stored(placed)
    leaders = large.select("key", F.col("leader").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("rep", gid(F.col("part").cast("bigint")))
    seats = stored(groups.select("rep", "gid").unionByName(leaders).distinct())
    met_inside = F.count("*").over(Window.partitionBy("token", "gid"))
    seated = posts.select("rep", "n", "token").join(bounded(seats), "rep").withColumn("k", met_inside).where("k > 1")
    inside = seated.groupBy("rep", "gid", "n").agg(F.count("*").alias("shared")).where(able(F.col("shared"))).select("rep", "gid")
    needed = stored(inside.join(reps, "rep"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                sets = [shingles(t, size).tobytes() for t in part["text"].to_pylist()]
                own = [_signature(x) == y for x, y in zip(sets, part["signature"].to_pylist(), strict=True)]  # rows may repeat a doc_id
                yield pa.RecordBatch.from_arrays([part["gid"], part["rep"], pa.array(sets, pa.binary())], ["gid", "rep", "tokens"]).filter(pa.array(own, pa.bool_()))

    def members(needed: DataFrame) -> DataFrame:
        """gid, and the (rep, tokens) of its members; rows that repeat a document count once."""
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(bounded(needed), "rep").select("gid", "rep", "signature", "text")
        found = texts.mapInArrow(tokens, "gid long, rep long, tokens binary")
        return found.groupBy("gid").agg(F.collect_set(F.struct("rep", "tokens")).alias("members"))  # about `group` members

    def opened(row: pa.Scalar) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = row.as_py()
        return np.array([r["rep"] for r in rows], np.int64), [np.frombuffer(r["tokens"], np.uint64) for r in rows]

    def open_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch["members"]:
                ids, own = opened(row)
                links = _spanning(_links(ids, own, ids, own, percent)) if len(own) > 1 else []
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    first = stored(members(needed).mapInArrow(open_own, "a long, b long"))

    # the matrix of what is not linked yet: a component is one group
    roots = components(first).select(F.col("node").alias("rep"), "root")
    held = roots.unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    block = stored(groups.join(held, "rep", "left").select("rep", "n", F.when(F.col("root").isNotNull(), F.xxhash64("root", F.lit("component"))).otherwise(F.col("gid")).alias("gid")))
    over = Window.partitionBy("token")
    seated = posts.select("rep", "n", "token").join(bounded(block.select("rep", "gid")), "rep").withColumn("far", F.min("gid").over(over) < F.max("gid").over(over))
    seated = stored(seated.where("far").drop("far"))
    far = stored(seated.groupBy("token", "gid").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    a, b = far.alias("a"), far.alias("b")
    sized = (100 * F.col("a.high") >= percent * F.col("b.low")) & (100 * F.col("b.high") >= percent * F.col("a.low"))
    met = a.join(b, "token").where((F.col("a.gid") < F.col("b.gid")) & sized).groupBy(F.col("a.gid").alias("g"), F.col("b.gid").alias("h"))
    pairs = stored(met.agg(F.count("*").alias("shared"), F.min(F.least("a.low", "b.low")).alias("low")).where(F.col("shared") >= enough(F.col("low"))).select("g", "h"))
    # members that share enough with what other groups have, in blocks; a block is named by its group and a number
    met = stored(pairs.select(F.explode(F.array("g", "h")).alias("gid")).distinct())
    across = seated.join(bounded(met), "gid", "left_semi").groupBy("rep", "gid", "n").agg(F.count("*").alias("shared")).where(able(F.col("shared"))).select("rep", "gid", "n")
    across = stored(across)
    split = across.join(bounded(_parts(across, "gid", group)), "gid", "left").select("rep", "gid", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).alias("part"))
    owners = stored(split.select("rep", F.col("gid").alias("of"), F.xxhash64("gid", "part").alias("gid")))

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, row in zip(batch["gid"].to_pylist(), batch["members"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([_record(*opened(row))], pa.binary())], ["gid", "record"])

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"], strict=True):
                links = _spanning(_links(*_members(left.as_py()), *_members(right.as_py()), percent))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    wanted = stored(owners.select("rep", "gid").join(reps, "rep"))
    records = members(wanted).mapInArrow(record, "gid long, record binary")
    records = stored(records.join(owners.select("gid", "of").distinct(), "gid").select("of", "record"))
    left, right = records.select(F.col("of").alias("g"), F.col("record").alias("left")), records.select(F.col("of").alias("h"), F.col("record").alias("right"))
    met = pairs.join(left, "g").join(right, "h").select("left", "right").mapInArrow(open_pairs, "a long, b long")
    return stored(first.unionByName(met))


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets = document_sets(docs, size, percent)
    links = similar_pairs(docs, sets, size, percent, group)
    known = sets.where("n_shingles > 0 and doc_id is not null")
    reps = known.groupBy("signature").agg(F.min("doc_id").alias("rep"))
    roots = components(links)
    placed = stored(reps.join(roots, reps["rep"] == roots["node"], "left").select("signature", F.coalesce("root", "rep").alias("component")))
    return sets.join(placed, "signature", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of docs, with all their columns, without documents whose component has a smaller doc_id."""
    found = classes(docs, **how)
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
