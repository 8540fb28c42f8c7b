"""Hard negatives, exact search and collocations against plain Python over small tables with awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import collocations, hard_negatives, queries, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, part string"


def fit(row):
    i, v, _ = row
    return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def rows():
    """Clusters, copies of one vector, other lengths, repeated ids and rows, nulls and non-finite components."""
    pick = random.Random(12)
    centres = [[pick.gauss(0, 1) for _ in range(10)] for _ in range(4)]
    out = [(k, [c + pick.gauss(0, 0.3) for c in centres[k % 4]], pick.randrange(3)) for k in range(230)]
    out += [(k, [0.5] * 10, k % 3) for k in range(300, 340)]  # one group of copies
    out += [(k, [pick.random() - 0.4 for _ in range(3)], k % 2) for k in range(400, 420)] + [(500, [], 1), (501, [], 1), (502, [], 0)]
    out += [(200, out[0][1], 1), (7, out[7][1], out[7][2]), (600, None, 1), (601, [None, *([1.0] * 9)], 1), (602, [float("nan")] * 10, 0), (603, [float("inf")] * 10, 0), (None, [1.0] * 10, 1), (700, [0.25] * 10, None), (800, [0.0] * 10, 2)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, 5, "x") for i, v, g in rows], SCHEMA).repartition(3)


def best(found, k):
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, rows, small, monkeypatch):
    """Equal to all pairs, also with many small blocks and cells."""
    if small:
        monkeypatch.setattr(topk, "packed", lambda *a: vectors.packed(*a, size=9))
        monkeypatch.setattr(vectors, "CELL_ROWS", 40)
        monkeypatch.setattr(vectors, "CELL_ASKS", 2)
        monkeypatch.setattr(topk, "CELL_BOUNDS", 3)
    own = [(i, whole(v, 1024)) for i, v, g in rows if fit((i, v, g))]
    asked = {}
    for i, q in own:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, q), q, key=lambda v: np.array(v, np.int32).tobytes())
    want = set()
    for i, q in asked.items():
        want |= {(i, n, j, s) for n, (s, j) in enumerate(best([(dot(q, x), j) for j, x in own if j != i and len(x) == len(q)], 10), 1)}
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert {i for i, *_ in want} >= {0, 100, 200, 300, 400, 500, 800}
    if small:
        none = table(spark, rows).limit(0)
        assert topk.top_k(none, F.col("vec_id") % 100 == 0).count() == 0 and topk.top_k(table(spark, rows), F.lit(False)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, rows, small, monkeypatch):
    if small:
        monkeypatch.setattr(hard_negatives, "packed", lambda *a: vectors.packed(*a, size=9))
        monkeypatch.setattr(vectors, "CELL_ROWS", 40)
        monkeypatch.setattr(vectors, "CELL_ASKS", 2)
    own = [(i, whole(v, 256), (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in rows if fit((i, v, g)) and g is not None]
    asked = {}
    for i, q, g in own:
        if i % 100 == 0:
            key = (g, np.array(q, np.int32).tobytes())
            if i not in asked or key < asked[i][0]:
                asked[i] = (key, q, g)
    want = Counter()
    for i, (_, q, g) in asked.items():
        scored = [(dot(q, x), j, h) for j, x, h in own if j != i and len(x) == len(q)]
        for p, j in best([(s, j) for s, j, h in scored if h == g], 5):
            for n, (s, k) in enumerate(best([(s, k) for s, k, h in scored if h != g and 30 * p <= 100 * s <= 90 * p], 10), 1):
                want[i, j, n, k, p, s] += 1
    frame = table(spark, rows)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, label=label).collect()
    assert Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == want and len(want) > 60
    if small:
        assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_prune():
    """Every refinement lies within the one before, around the exact score; of vectors whose segments are alike few are scored."""
    draw = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(draw.normal(size=(8, 8)), 8, axis=1)[draw.integers(0, 8, 500)] + 0.1 * draw.normal(size=(500, 64)))).astype(np.int64)
    sums = hard_negatives.Summaries(*hard_negatives.summarised(x), 64)
    every, exact = np.arange(500), x @ x[3]
    for level in range(3):
        low, high = sums.bounds(level, sums, 3, every)
        assert (low <= exact).all() and (exact <= high).all()
    opened = []
    rows, scores = hard_negatives.best(sums, sums, 3, every, lambda k, r: (opened.append(len(r)), x[r] @ x[k])[1], 5, [hard_negatives.EVERY])
    assert set(np.argsort(-exact, kind="stable")[:5]) <= set(rows[np.argsort(-scores, kind="stable")[:5]]) and opened[0] < 150


def test_products_are_exact_or_refused():
    big = np.array([[1 << 30, 1]], np.int64)
    assert vectors.product(big, big)[0, 0] == (1 << 60) + 1
    with pytest.raises(ValueError, match="64 bits"):
        vectors.product(big * 4, big * 4)


PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def phrases(docs, least, top):
    counts, total = Counter(), Counter()
    for g, t in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in PIECES.split(lower):
            w = WORDS.findall(piece)
            total[g or "und"] += len(w)
            for k in (1, 2, 3):
                counts.update((g or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    rows = {}
    for (g, p), a in often.items():
        longer = [b for (h, q), b in often.items() if h == g and len(q) == 3 > len(p) and p in (q[:2], q[1:])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[g, p[:k]] * counts[g, p[k:]]), k, counts[g, p[:k]], counts[g, p[k:]]) for k in range(1, len(p))]
        s, _, left, right = min(cuts)
        rows.setdefault(g, []).append((-s, -a, " ".join(p).encode(), left, right, total[g]))
    return {(g, n, p.decode(), -a, left, right, every, -s) for g, own in rows.items() for n, (s, a, p, left, right, every) in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize(("shards", "bits", "chunk"), [(2, 24, 1 << 23), (1, 6, 1 << 23), (3, 12, 300)])
def test_collocations(spark, shards, bits, chunk, monkeypatch):
    """Equal to counting everything, with one to three shards, with cells that many phrases share, and with texts cut into many chunks."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    pick = random.Random(21)
    words = ["new", "York", "City", "of", "the", "Größe", "été", "a\x1cb", "x"]
    docs = [(pick.choice(["en", "de", None, "und"]), pick.choice(["", ".", "\t", "\n"]).join(" ".join(pick.choice(words) for _ in range(pick.randrange(1, 9))) for _ in range(6))) for _ in range(90)]
    docs += [("en", "NEW york City!new york, CITY the of")] * 12 + [("en", None), ("fr", ""), ("fr", " .,;\t\n"), ("en", "of the " * 400), ("en", "é" * 2000)]
    frame = spark.createDataFrame([(k, t, g, "s", 1) for k, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, a long").repartition(3)
    got = collocations.collocations(frame, shards=shards, bits=bits, top=40).collect()
    want = phrases(docs, 10, 40)
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == want and len(got) == len(want) > 40
    if shards == 1:
        assert collocations.collocations(frame.limit(0)).count() == 0 and collocations.collocations(frame.where("lang = 'fr'")).count() == 0


def test_numbers_of_many_words():
    """Codes that don't fit 64 bits are numbered first."""
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 5, 300) + (1 << 22) - 5 for _ in range(3)]
    found, count = collocations._distinct(columns, 1 << 22)
    assert Counter(zip(*(c.tolist() for c in columns), strict=True)) == dict(zip(zip(*(c.tolist() for c in found), strict=True), count.tolist(), strict=True))


def test_registered_queries_run_over_the_tables(spark):
    for name in ("op11_hard_negatives", "op12_top_k", "op13_collocations"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and name in queries.ORACLE_SQL
