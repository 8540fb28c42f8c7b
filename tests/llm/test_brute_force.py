"""Queries that SQL can't express, against plain Python over small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import decontam, langid, ngram_join, queries, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, folder, rows, labels=(), benchmark=()):
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def gram(chars, bits):
    h = len(chars) * 0x9E3779B1 & 0xFFFFFFFF
    for c in chars:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)


def grams(text, orders, bits):
    return [gram(text[k : k + n], bits) for n in orders for k in range(len(text) - n + 1)]


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    own = {"en": "the of and house tree River walks under Bridge 7 years".split(), "de": "der die und Haus Baum Fluss geht über Brücke 7 Jahre".split()}
    out = [(k, " ".join(pick.choice(own[g]) for _ in range(pick.randint(1, 90))) + pick.choice(["", ".", "!\nNext line, (x)"]), g) for k in range(90) for g in [("en", "de")[k % 2]]]
    return out + [(200, None, "en"), (201, "", "de"), (202, "123 !", "en"), (203, "word " * 3000, None), (204, "É ß 中", "de"), (None, "the house of the river", "en"), (205, "#*#* %% QQ 99 " * 30, "en")]


def test_languages(spark, rows, tmp_path):
    sf = write(spark, tmp_path, rows)
    counts, docs = defaultdict(Counter), Counter()
    for i, t, g in rows:
        if not held(i) and g is not None:
            docs[g] += 1
            counts[g].update(grams((t or "").lower(), langid.ORDERS, langid.BITS))
    size = 1 << langid.BITS
    total = {g: sum(c.values()) + 0.5 * size for g, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op5_langid(spark, sf).collect()}
    for i, t, _ in rows:
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        seen = grams(t.lower(), langid.ORDERS, langid.BITS)
        logs = {g: math.log(docs[g] / sum(docs.values())) + sum(math.log((counts[g][h] + 0.5) / total[g]) for h in seen) for g in counts}
        best = max(logs, key=logs.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-3
        assert got[i]["held_out"] == held(i)


def test_toxicity(spark, rows, tmp_path):
    """Ratios by hand, a fit that is at its optimum, and scores that are sums over the distinct n-grams of whole texts."""
    labels = [(i, 0, int(g == "de")) for i, _, g in rows if i is not None and g] + [(77, 0, None)]
    sf = write(spark, tmp_path, rows, labels)
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, b = toxicity.fit(docs, known)
    train = [(set(grams((t or "").lower(), toxicity.ORDERS, toxicity.BITS)), int(g == "de")) for i, t, g in rows if i is not None and g and not held(i)]
    n = [sum(1 for _, y in train if y == k) for k in (0, 1)]
    found = [Counter(h for s, y in train if y == k for h in s) for k in (0, 1)]
    ratio = {h: math.log((found[1][h] + 1) / (n[1] + 2)) - math.log((found[0][h] + 1) / (n[0] + 2)) for h in found[0] | found[1] if found[0][h] + found[1][h] >= toxicity.SUPPORT}
    ratio = {h: r for h, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO}
    assert set(np.flatnonzero(weights).tolist()) <= set(ratio) and len(ratio) > 20
    value = lambda s: b + sum(float(weights[h]) for h in s)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    error = [(s, sigmoid(value(s)) - y) for s, y in train]
    slope = [abs(sum(e for s, e in error if h in s) * r / len(train) + toxicity.PENALTY * float(weights[h]) / r) for h, r in ratio.items()]
    assert max(slope) < 0.02
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, sf).collect()}
    for i, t, _ in rows:
        p = sigmoid(value(set(grams((t or "").lower(), toxicity.ORDERS, toxicity.BITS))))
        assert abs(got[i]["score"] - p) < 1e-4 and got[i]["predicted"] == (got[i]["score"] >= 0.5) and got[i]["held_out"] == held(i)


def test_quality_distance(spark, rows, tmp_path):
    sf = write(spark, tmp_path, rows)
    shown = "#*$%&|<>"

    def classes(t):
        kinds = [len(re.findall(p, t)) for p in ("[A-ZÀ-ÖØ-Þ]", "[0-9]", r"[.,;:!?'\"()\-]")] + [sum(c in shown for c in t), len(t) - sum(map(len, WORDS.findall(t)))]
        return [*kinds, len(t)]

    def shares(c):
        return [k / max(c[5], 1) for k in (*c[:5], max(c[5] - sum(c[:5]), 0))]

    def term(p, q):
        half = lambda a: a * math.log2(2 * a / (p + q)) if a > 0 else 0.0
        return (half(p) + half(q)) / 2

    by = defaultdict(list)
    for _, t, g in rows:
        if g:
            by[g].append(t or "")
    refs = {}
    for g, texts in by.items():
        count = Counter(w for t in texts for w in WORDS.findall(t))
        top = sorted(count, key=lambda w: (-count[w], w.encode()))[: quality.COMMON]
        refs[g] = {w: count[w] / sum(count.values()) for w in top}, shares([sum(x) for x in zip(*map(classes, texts), strict=True)])
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, sf).collect()}
    for i, t, _ in rows:
        t = t or ""
        own, words = shares(classes(t)), Counter(WORDS.findall(t))
        n = sum(words.values())
        distances = []
        for g, (q, c) in refs.items():
            p = {w: words[w] / max(n, 1) for w in q}
            part = sum(term(p[w], q[w]) for w in q) + term(max(1 - sum(p.values()), 0), max(1 - sum(q.values()), 0))
            root = lambda x: math.sqrt(max(x, 0))
            distances.append(((root(part) + root(sum(map(term, own, c)))) / 2, g))
        best, nearest = min(distances)
        assert abs(got[i]["distance"] - best) < 1e-5 and (got[i]["nearest"] == nearest or abs(distances[0][0] - distances[1][0]) < 1e-9), i
        assert got[i]["kept"] == (not got[i]["base_failed"] and (n < quality.LEAST_WORDS or best <= quality.MOST_DISTANCE))


def tokens(text):
    out, words = [], WORDS.findall(text)
    plain = lambda w: "".join(c for c in w if c.isalnum()).lower()
    for k, w in enumerate(words):
        before = words[k - 1] if k else None
        if re.match(r"[$€£(\"']*[+-]?[0-9]", w):
            kind = "<num>"
        elif before and re.search("[0-9]", before) and plain(w) in decontam.UNITS:
            kind = "<unit>"
        elif before and re.match(r"[(\"']*[A-Z][a-z]", w) and not re.search(r"[.!?:]['\")]*$", before):
            kind = "<name>"
        else:
            kind = plain(w)
        out.append((kind, plain(w)))
    return out


def held_items(docs, items, width=8, least=5):
    """{(doc, item): windows}: every window of every item against every place of every text."""
    out = {}
    for i, text in docs:
        own = tokens(text or "")
        for item, body in items:
            whole = tokens(body or "")
            size = min(width, len(whole))
            hits = set()
            names = 0
            for w in range(len(whole) - size + 1 if whole else 0):
                slots = whole[w : w + size]
                if not any(v for _, v in slots):
                    continue
                names += 1
                strict = not any(k and not k.startswith("<") for k, _ in slots)
                for at in range(len(own) - size + 1):
                    there = own[at : at + size]
                    pairs = frozenset((a[0], a[1], b[1]) for a, b in zip(slots, there, strict=True) if a[0].startswith("<"))
                    one = all(len({(p[0], p[s]) for p in pairs}) == len(pairs) for s in (1, 2))
                    if [k for k, _ in slots] == [k for k, _ in there] and one and not (strict and slots != there):
                        hits.add((w, pairs))
            votes = Counter(p for _, pairs in hits for p in pairs)
            to = {s: {} for s in (1, 2)}
            for p, v in votes.items():
                for s in (1, 2):
                    key = p[0], p[s]
                    to[s][key] = max(to[s].get(key, (0, "")), (v, p[3 - s]))
            fair = {w for w, pairs in hits if all(to[1][p[0], p[1]][1] == p[2] and to[2][p[0], p[2]][1] == p[1] for p in pairs)}
            if fair and (len(fair) >= least or 2 * len(fair) >= names):
                out[i, item] = len(fair), names
    return out


def test_decontamination(spark, tmp_path):
    pick = random.Random(4)
    long = "On Monday Alice drove 120 miles from Oslo and then another 30 miles past the old mill before she met Bob for lunch near the bridge in 2 hours"
    items = [(1, long), (2, "short item about gardens"), (3, None), (4, ""), (5, "12 + 30 = 42"), (6, "?!"), (7, "Maria has 3 apples and buys 4 more apples at 2 dollars each how much does Maria pay for them in all")]
    vocabulary = long.split() + items[6][1].split() + ["12", "+", "=", "42", "short", "gardens"]
    docs = [(k, " ".join(pick.choice(vocabulary) for _ in range(60))) for k in range(30)]
    swap = lambda t, **m: " ".join(m.get(w, w) for w in t.split())
    docs += [
        (100, f"Intro here. {long} and more"), (101, swap(long, Alice="Maria", Bob="Tom")), (102, long.replace("120", "450").replace("30 miles", "77 miles")), (103, long.replace("30 miles", "120 miles")),
        (104, long.replace("120", "9") + " so " + long.replace("120", "11")), (105, "see 12 + 30 = 42 now"), (106, "see 13 + 30 = 43 now"), (107, "a short item about gardens"), (108, None), (109, ""), (110, swap(items[6][1], Maria="Peter")),
        (111, " ".join(long.split()[:12])), (112, long), (112, "another text under the same id"), (None, items[6][1]),
    ]
    sf = write(spark, tmp_path, [(i, t, "en") for i, t in docs], benchmark=[*items, items[0]])
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"]) for r in queries.op9_decontamination(spark, sf).collect()}
    expected = held_items(docs, items)
    assert got == expected and {(100, 1), (101, 1), (102, 1), (105, 5), (107, 2), (110, 7), (None, 7)} <= set(got) and (106, 5) not in got
    assert got[103, 1][0] < got[100, 1][0]
    frame = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("clash") for c in ("row", "id", "key", "d", "t")})
    left = decontam.without_benchmark(frame, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert left.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, t) for i, t in docs if not any(held_items([(i, t)], items)))


def test_clashing_names(spark):
    names = ("row", "id", "key", "d", "t", "gone", "gone_doc", "bad_doc", "set_id", "token", "rep", "gid")
    frame = spark.createDataFrame([(1, "a b c d e f", *["x"] * len(names)), (2, "a b c d e f", *["x"] * len(names))], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    from hirelens.llm import line_dedup

    assert ngram_join.one_of_each(frame).columns == frame.columns and [r["doc_id"] for r in ngram_join.one_of_each(frame).collect()] == [1]
    out = line_dedup.without_lines(frame, line_dedup.removed_lines(frame))
    assert out.columns == frame.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b c d e f", 2: ""}


@pytest.mark.parametrize("group", [64, 3])
def test_large_groups_of_near_copies(spark, group):
    """A chain of texts that drifts away from its first, beside a group around one text and texts that link two groups."""
    pick = random.Random(9)
    word = lambda: f"w{pick.randrange(10**6)}"
    base = [word() for _ in range(200)]
    docs = []
    for k in range(60):
        base = list(base)
        base[pick.randrange(200)] = word()
        docs.append((k, " ".join(base)))
    other = [word() for _ in range(150)]
    for k in range(60):
        copy = list(other)
        for _ in range(k % 5):
            copy[pick.randrange(150)] = word()
        docs.append((1000 + k, " ".join(copy)))
    docs.append((3000, " ".join(word() for _ in range(40)) + " " + docs[0][1]))
    pick.shuffle(docs)
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in docs}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.classes(frame, group=group).collect()} == root


def test_target_mixture(spark, tmp_path):
    """Weights of 3 to 1 hold in every window until a queue is dry; then the other one fills them alone."""
    from hirelens.llm import packing

    rows = [(k, f"some words of document {k} " * 8, "large" if k % 2 else "small") for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(frame, sequence=64, window_sequences=4, target={"large": 3.0, "*": 1.0}).toPandas()
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()
    window = out.groupby([out.sequence_id // 4, "source"]).length.sum().unstack(fill_value=0)
    dry = int(np.flatnonzero(window["large"].to_numpy())[-1])
    assert dry < len(window) - 2 and (abs(window["large"][:dry] - 192) <= 2).all() and (window["small"][dry + 1 : -1] == 256).all()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all()


def test_deficits_are_carried():
    """Windows filled round by round, from the first or from any later one, give what the closed form says, through queues that run dry; each queue stays within a token or so of its due."""
    from hirelens.llm.packing import Course, Mixture

    pick = random.Random(7)
    for weights in (None, [3.0, 1.0, 1.0, 0.5, 0.0], [1.0, 1.0, 5.0, 5.0, 0.0]):
        lengths = [*[pick.randrange(1, 900) for _ in range(4)], 0]
        mix = Mixture(lengths, weights)
        k = np.arange(-(-mix.total // 37) + 2)
        closed = mix.given(np.minimum(k * 37, mix.total))
        for first in (0, 3, 11):
            assert (Course(mix, 37, first).before(k[first:]) == closed[:, first:]).all()
        course = Course(mix, 37, 0)
        course.before(k[:2])
        assert any(course.deficits) and closed[:, -1].tolist() == lengths
        if weights is None:
            assert (abs(closed - np.minimum(k * 37, mix.total) * (np.array(lengths) / mix.total)[:, None]) < len(lengths)).all()


def test_temperature(spark):
    """Sources share the first windows by the power of their tokens."""
    from hirelens.llm import packing

    rows = [(k, "some words " * 8, "large" if k % 10 else "small") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(frame, sequence=64, window_sequences=4, temperature=0.5).toPandas()
    first = out[out.sequence_id < 16].groupby("source").length.sum()
    assert abs(first["large"] / first["small"] - 3) < 0.05 and out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()


def test_many_languages(spark):
    """Blocks of languages give what one matrix gives."""
    pick = random.Random(2)
    rows = [(k, " ".join(pick.choice([f"{a}{k % 9}", f"{a}{a}"]) for a in "abcdefgh" * 3), f"g{k % 9}") for k in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = ({r["doc_id"]: r for r in langid.identify(frame, languages=n).collect()} for n in (512, 2))
    assert all(one[k]["lang_pred"] == many[k]["lang_pred"] and abs(one[k]["score"] - many[k]["score"]) < 1e-6 for k in one) and len(one) == 90


def test_pipeline(spark, tmp_path):
    """The rows of the whole pipeline: every stage in plain Python on what the one before kept, with the fitted weights of the classifier."""
    import corpus_pipeline
    from hirelens.llm.chunks import vocabulary
    from tokenizers import Tokenizer

    pick = random.Random(21)
    plain, rude = "the of house tree river walks under bridge years stone light water".split(), "idiot fool hate stupid trash dumb".split()
    line = lambda n, extra=(): " ".join(pick.choice([*plain, *extra]) + str(pick.randrange(40)) for _ in range(n))
    item = "Alice paid 12 dollars for 3 books and then 7 more dollars for one pen at the corner shop"
    docs = [(k, "\n".join(line(pick.randint(4, 30), rude * 4 if k % 4 == 0 else ()) for _ in range(pick.randint(1, 4)))) for k in range(80)]
    base = line(60).split()
    for k in range(8):  # near copies
        copy = list(base)
        copy[k * 3] = f"changed{k}"
        docs.append((100 + k, " ".join(copy)))
    docs += [(119, "\n".join(" ".join(base[k : k + 6]) for k in range(0, 60, 6))), (120, docs[1][1]), (121, docs[2][1].split("\n")[0] + "\n" + line(9)), (122, f"So {item} today"), (123, item.replace("12", "15").replace("7", "9")), (124, None), (125, ""), (None, "no id here"), (126, docs[5][1] + "\n" + line(12))]
    labels = [(i, 0, int(i % 4 == 0)) for i, _ in docs if i is not None and i < 80]
    sf = write(spark, tmp_path, [(i, t, "en") for i, t in docs], labels, [(1, item)])
    weights, b = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = [(i, t) for i, t in docs if b + sum(float(weights[h]) for h in set(grams((t or "").lower(), toxicity.ORDERS, toxicity.BITS))) < 0]
    assert 40 < len(left) < len(docs)

    order = sorted(left, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, kept = [], {}
    for i, t in order:
        own = []
        for x in (t or "").split("\n"):
            s = set(WORDS.findall(x.lower()))
            if not (s and any(9 * len(s & y) >= 4 * (len(s) + len(y)) for y in seen)):
                own.append(x)
            if s:
                seen.append(s)
        kept[i] = t if t is None else "\n".join(own)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORDS.findall((t or "").lower())) else set() for i, t in kept.items()}
    root = {i: i for i in sets}
    for _ in range(len(root)):
        for x in sets:
            for y in sets:
                if x is not None and y is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    kept = {i: t for i, t in kept.items() if root[i] == i}
    kept = {i: t for i, t in kept.items() if not held_items([(i, t)], [(1, item)])}
    assert 100 in kept and kept[101] == "" and not {119, 122, 123} & set(kept)

    library = Tokenizer.from_file(vocabulary())
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(kept)
    used = defaultdict(list)
    for i, t in kept.items():
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            at += r["length"]
            used[r["sequence_id"]].append((r["offset"], r["length"]))
        assert at == len(ids)
    for s in used.values():
        assert sorted(s)[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(sorted(s), sorted(s)[1:], strict=False)) and sum(n for _, n in s) <= 2048
