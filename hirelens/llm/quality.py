"""Quality rules, then divergence from the histograms of a language; DataFrame functions only.

Every language's reference is counted over all its documents: shares of character classes,
and shares of its COMMON most frequent words among all words. A document is compared with
every language by the mean of two Jensen-Shannon distances (base 2, 0 to 1), classes and
common words, and the nearest language counts. Documents with fewer than LEAST_WORDS words
are too short to be judged by the distances; the base rules alone decide on them.

Cases: null text has no words and fails the base rules; without any language nothing is
judged by distance; a null language gives no reference but is judged like others; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import BLANKS, stored

COMMON, WINDOW = 32, 8
#: References of up to so many languages are broadcast at once; common words of more are joined by a shuffle.
LANGUAGES = 512
LEAST_WORDS, MOST_DISTANCE = 50, 0.34
SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "digit", "mark", "symbol", "blank", "other")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gone(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Positions inside windows whose hash occurs twice or more, of the array of window hashes."""
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda s, e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
    twice = let(ordered, lambda s: F.filter(s, lambda e, k: same(s, e, k + 1) | ((k > 0) & same(s, e, k - 1))))
    at = F.sort_array(F.transform(twice, lambda e: e["i"]))
    step = lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["end"], p)).alias("n"), (p + width).alias("end"))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key, the base counts and the class counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.array_remove(F.split(text, BLANKS), "").alias("words"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    rows = rows.withColumn("windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.length(text).cast("long")
    word_chars = F.length(F.regexp_replace(text, BLANKS, "")).cast("long")
    symbols = (n_chars - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    return rows.select(
        "doc_id", "lang", F.xxhash64(text).alias("text_key"),
        F.size("words").cast("long").alias("n_words"), word_chars.alias("word_chars"), symbols.alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.array(_gone(text, "[A-ZÀ-ÖØ-Þ]+"), _gone(text, "[0-9]+"), _gone(text, r"[.,;:!?'\"()\-]+"), symbols, n_chars - word_chars, n_chars).alias("classes"),
    )


def _shares(classes: Column) -> Column:
    """Shares of the classes; the last entry comes in as all characters and leaves as the rest."""
    total = F.get(classes, F.lit(len(CLASSES) - 1))
    known = [F.get(classes, F.lit(k)) for k in range(len(CLASSES) - 1)]
    rest = F.greatest(total - sum(known[1:], known[0]), F.lit(0))
    return F.array(*[(k / F.greatest(total, F.lit(1))).cast("double") for k in [*known, rest]])


def _divergence(p: Column, q: Column) -> Column:
    """The term of one bin in the Jensen-Shannon divergence to base 2."""
    half = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(F.lit(0.0))
    return (half(p) + half(q)) / 2


def spread_words(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key, word of every word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("text_key"), F.explode(F.split(text, BLANKS)).alias("word"))
    return rows.where("word <> ''")


def references(docs: DataFrame, rows: DataFrame, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Stored: (lang, word, q, mass) of the most common words; (lang, shares, base): base is the word part of a text without any of them."""
    known = rows.where(F.col("lang").isNotNull())
    counts = spread_words(docs).where(F.col("lang").isNotNull()).groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common)
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))]
    total = stored(known.groupBy("lang").agg(F.sum("n_words").alias("all"), *sums))
    mass = F.sum("q").over(Window.partitionBy("lang"))  # `common` rows a language
    words = stored(best.join(total, "lang").select("lang", "word", (F.col("n") / F.col("all")).alias("q")).withColumn("mass", mass))
    own = words.groupBy(F.col("lang").alias("l")).agg(F.first("mass").alias("m"))
    base = _word_part(F.lit(1.0), F.coalesce("m", F.lit(0.0)))
    shares = _shares(F.array(*[F.col(f"c{k}") for k in range(len(CLASSES))]))
    return words, stored(total.join(own, F.col("lang") == F.col("l"), "left").select("lang", shares.alias("shares"), base.alias("base")))


def _word_part(rest_p: Column, mass: Column) -> Column:
    """The divergence of the words, but for the bins of common words that a text has: each adds to it what it is beyond q / 2."""
    return mass / 2 + _divergence(rest_p, F.greatest(1 - mass, F.lit(0.0)))


def nearest(rows: DataFrame, languages: DataFrame, matched: str) -> DataFrame:
    """rows with least (distance, lang). matched: the column that maps a language to a text's word part, where it has common words of it.

    Languages come as blocks of about LANGUAGES, one row of bounded size each, and every text sees each block where it lies.
    """
    blocks = -(-languages.count() // LANGUAGES)
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    own, leasts = _shares(F.col("classes")), []
    class_part = lambda e: let(own, lambda s: sum((_divergence(F.get(s, F.lit(k)), F.get(e["shares"], F.lit(k))) for k in range(1, len(CLASSES))), _divergence(F.get(s, F.lit(0)), F.get(e["shares"], F.lit(0)))))
    word_part = lambda e: F.coalesce(F.try_element_at(F.col(matched), e["lang"]), e["base"])
    for k in range(blocks):
        block = languages.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).agg(F.collect_list(F.struct("lang", "shares", "base")).alias(f"block{k}"))
        rows = rows.crossJoin(F.broadcast(block))  # one row
        leasts.append(F.array_min(F.transform(f"block{k}", lambda e: F.struct(((root(word_part(e)) + root(class_part(e))) / 2).alias("distance"), e["lang"].alias("lang")))))
    none = F.lit(None).cast("struct<distance:double,lang:string>")
    return rows.withColumn("least", F.array_min(F.array(*leasts)) if leasts else none).drop(*[f"block{k}" for k in range(blocks)])


def judge(docs: DataFrame, common: int = COMMON, least_words: int = LEAST_WORDS, most: float = MOST_DISTANCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nearest, distance."""
    rows = stored(base_rules(docs))
    words, languages = references(docs, rows, common)
    small = F.broadcast if languages.limit(LANGUAGES + 1).count() <= LANGUAGES else lambda df: df  # `common` rows a language
    spread = spread_words(docs).select("doc_id", "text_key", "word").join(small(words.select("word").distinct()), "word", "left_semi")
    counts = spread.groupBy("doc_id", "text_key", "word").agg(F.count("*").alias("n"))
    copies = rows.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg((F.count("*") * F.max("n_words")).alias("of"))
    found = counts.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).drop("d", "t")
    p = F.col("n") / F.greatest("of", F.lit(1))
    bins = found.join(small(words), "word").groupBy("doc_id", "text_key", "lang").agg(F.first("mass").alias("mass"), F.sum(p).alias("p"), F.sum(_divergence(p, F.col("q")) - F.col("q") / 2).alias("own"))
    part = F.col("own") + _word_part(F.greatest(1 - F.col("p"), F.lit(0.0)), F.col("mass"))
    matched = bins.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("lang"), part.alias("part")))).alias("matched"))
    joined = nearest(rows.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left"), languages, "matched")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fits = (F.col("n_words") < least_words) | F.coalesce(F.col("least.distance") <= most, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), F.col("least.lang").alias("nearest"), F.round("least.distance", 6).alias("distance"))
