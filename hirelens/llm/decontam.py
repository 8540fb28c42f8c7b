"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Words become template tokens: numbers `<num>`, units after a number `<unit>`, capitalised
words inside a sentence `<name>`, and others their lower-cased letters and digits. Windows
of WIDTH template tokens of the benchmark are hash-joined with the same windows of the
documents. A window counts if its slots are consistent: equal values of the item stand for
equal values in the document and the other way round, so that re-parameterised questions
match and mere look-alikes don't. That holds within a window and over all of an item's
windows in a document: where they contradict each other, the pairing of values that most
windows have stands, and windows with another one don't count. An item is found in a
document if LEAST_WINDOWS of its windows, or half of them, are there.

Not every window of a document is hashed: every benchmark window has an anchor, its longest
plain word; documents' words are looked up among the anchors first, which loses nothing,
because equal windows have equal anchors. The benchmark goes in blocks of at most
BLOCK_WINDOWS windows, so that what is broadcast is bounded.

Cases: null and blank texts match nothing; an item shorter than WIDTH words is one window;
a window without a plain word (sums, lists of names) has no template of its own and must
match in its values too, and one of marks alone is left out; rows that repeat an item or a
document change nothing; rows that repeat a doc_id, or have none, are told apart by their
text; an empty benchmark or documents table gives no rows; other columns are ignored, and
carried by `without_benchmark`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import stored, words_of

WIDTH, LEAST_WINDOWS, BLOCK_WINDOWS = 8, 5, 200_000
#: Units that follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs hour hours day days week weeks month months year years kmh mph hz w kw v a j n pa bar k c f usd eur gbp dollars euros cents percent meters metres miles minutes seconds".split()
_MARKS = r"[^\p{L}\p{N}]"


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, _MARKS, ""))


def template(words: Column) -> Column:
    """array<struct<token, value>> of an array of words; the word before the first is not known."""

    def token(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1))
        number = w.rlike(r"^[$€£(\"']*[+-]?[0-9]")
        unit = before.rlike("[0-9]") & _plain(w).isin(*UNITS)
        name = w.rlike(r"^[(\"']*\p{Lu}\p{Ll}") & ~before.rlike(r"[.!?:]['\")]*$")
        kind = F.when(number, "<num>").when(unit, "<unit>").when(name, "<name>").otherwise(_plain(w))
        return F.struct(kind.alias("token"), _plain(w).alias("value"))

    return F.transform(words, token)


def _hash(window: Column) -> Column:
    return F.xxhash64(F.transform(window, lambda t: t["token"]))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, window (its number), size, before (words ahead of the anchor), anchor, strict (values must match), window_hash, slots."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("tokens", template(F.col("words"))).withColumn("n", F.size("tokens"))
    size = F.least(F.col("n"), F.lit(width))
    windows = items.select("item_id", "tokens", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("window"))
    windows = windows.withColumn("slots", F.slice("tokens", F.col("window") + 1, F.col("size")))
    # the longest plain word, or else the longest value of a slot
    plain = lambda t: ~t["token"].rlike("^<") & (t["token"] != "")
    ranked = F.transform("slots", lambda t, i: F.struct(plain(t).alias("plain"), F.length(t["value"]).alias("length"), t["value"].alias("anchor"), i.alias("before")))
    best = F.array_max(ranked)
    return windows.select("item_id", "window", "size", best["before"].alias("before"), best["anchor"].alias("anchor"), (~best["plain"]).alias("strict"), _hash(F.col("slots")).alias("window_hash"), "slots").where(best["length"] > 0)


def slot_pairs(item: Column, doc: Column) -> Column:
    """array<struct<kind, a, b>>: which value of the item stands for which of the document, of two equal windows."""
    pairs = F.zip_with(item, doc, lambda a, b: F.when(a["token"].rlike("^<"), F.struct(a["token"].alias("kind"), a["value"].alias("a"), b["value"].alias("b"))))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def consistent(pairs: Column) -> Column:
    """A value of one side goes with one value of the other."""
    one = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p[side])))) == F.size(pairs)
    return one("a") & one("b")


def agreeing(windows: DataFrame) -> DataFrame:
    """The windows (doc_id, text_key, item_id, window, exact, pairs) whose pairs are those that most windows of their item and document have, both ways."""
    at = ["doc_id", "text_key", "item_id"]
    slots = windows.withColumn("own", F.xxhash64("pairs")).select(*at, "window", "own", "exact", F.explode_outer("pairs").alias("p")).select(*at, "window", "own", "exact", "p.*")
    over = lambda *c: Window.partitionBy(*at, "kind", *c)
    voted = slots.withColumn("v", F.count("*").over(over("a", "b")))
    to_b, to_a = F.max(F.struct("v", "b")).over(over("a"))["b"], F.max(F.struct("v", "a")).over(over("b"))["a"]
    fair = voted.withColumn("fair", F.col("kind").isNull() | ((to_b == F.col("b")) & (to_a == F.col("a"))))
    return fair.groupBy(*at, "window", "own").agg(F.bool_and("fair").alias("fair"), F.bool_or("exact").alias("exact")).where("fair")


def found(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """doc_id, text_key, item_id, n_windows (found), item_windows, exact (windows with equal slot values), for texts that hold an item."""
    windows = stored(benchmark_windows(benchmark, width))
    n = windows.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words_of("text").alias("words")).where(F.size("words") > 0)
    met = []
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == block)  # about BLOCK_WINDOWS rows
        # one row an anchor: the places that a window may have around it
        anchors = part.select(F.xxhash64("anchor").alias("anchor_hash"), "before", "size").distinct().groupBy("anchor_hash").agg(F.collect_list(F.struct("before", "size")).alias("places"))
        spread = words.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "word")).withColumn("anchor_hash", F.xxhash64(_plain(F.col("word"))))
        hits = spread.join(F.broadcast(anchors), "anchor_hash").select("doc_id", "text_key", "words", "at", F.explode("places").alias("place"))
        start = F.col("at") - F.col("place.before")
        # one word more in front, for what it says of the first
        near = hits.where((start >= 0) & (start + F.col("place.size") <= F.size("words"))).select("doc_id", "text_key", F.col("place.size").alias("size"), F.when(start > 0, F.slice("words", start, F.col("place.size") + 1)).otherwise(F.concat(F.array(F.lit(None).cast("string")), F.slice("words", start + 1, F.col("place.size")))).alias("near"))
        tokens = near.withColumn("tokens", template(F.col("near"))).select("doc_id", "text_key", F.slice("tokens", F.lit(2), F.col("size")).alias("doc_slots"))
        tokens = tokens.withColumn("window_hash", _hash(F.col("doc_slots")))
        joined = tokens.join(F.broadcast(part.select("window_hash", "item_id", "window", "strict", "slots")), "window_hash")
        exact = F.transform("slots", lambda t: t["value"]) == F.transform("doc_slots", lambda t: t["value"])
        joined = joined.withColumns({"exact": exact, "pairs": slot_pairs(F.col("slots"), F.col("doc_slots"))})
        met.append(joined.where((F.col("exact") | ~F.col("strict")) & consistent(F.col("pairs"))).groupBy("doc_id", "text_key", "item_id", "window", "pairs").agg(F.bool_or("exact").alias("exact")))
    good = agreeing(stored(reduce(DataFrame.unionByName, met)))
    by_item = good.groupBy("doc_id", "text_key", "item_id").agg(F.count_distinct("window").alias("n_windows"), F.count_distinct(F.when(F.col("exact"), F.col("window"))).alias("exact"))
    sizes = F.broadcast(windows.groupBy("item_id").agg(F.count("*").alias("item_windows"))) if n <= BLOCK_WINDOWS else windows.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    enough = (F.col("n_windows") >= least_windows) | (2 * F.col("n_windows") >= F.col("item_windows"))
    return by_item.join(sizes, "item_id").where(enough).select("doc_id", "text_key", "item_id", "n_windows", "item_windows", "exact")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, exact of each document with an item; of texts under one id, that with the most windows counts."""
    most = F.max(F.struct("n_windows", "exact", "item_windows")).alias("m")
    return found(docs, benchmark, width, least_windows).groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", "m.n_windows", "m.item_windows", "m.exact")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item."""
    bad = stored(found(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")), "left_anti").select("row.*")
