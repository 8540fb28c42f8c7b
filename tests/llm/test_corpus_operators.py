"""Operators against brute force on small made-up tables with awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import components, decontam, langid, line_dedup, ngram_join, packing, quality, token_counts, token_output, toxicity, warc
from hirelens.llm.chunks import encoder, vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_id string, token string"
#: What every operator must get through: nulls, blanks, one very long text, odd characters.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "don't  stop\n\n  x"), (904, "é中文 \U0001f600 a\x00b"), (905, "x"), (906, " ".join(f"w{i % 977}" for i in range(30_000)))]


def documents(spark, rows):
    full = [(i, t, "en" if (i or 0) % 2 else "de", None if i == 3 else f"s{(i or 0) % 3}", len(t or ""), "clash", "clash") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "xe", "zu", "pa")]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    out = [(i, "\n".join(text(pick.randint(3, 25)) for _ in range(pick.randint(1, 5)))) for i in range(60)]
    base = text(60)
    for k in range(25):  # a group of near copies of each other, some exact
        copy = base.split(" ")
        for _ in range(k % 4):
            copy[pick.randrange(60)] = pick.choice(words)
        out.append((100 + k, " ".join(copy)))
    out += [(200 + k, out[k][1]) for k in range(5)]
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, [*rows, (None, "a row without an id")]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def encoded(text, end):
    return np.array([*encoder(vocabulary()).whole.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_chunks_equal_the_whole(rows):
    e = encoder(vocabulary())
    texts = [t for _, t in rows if t] + ["a  b", " a", "a ", "it's we'll 12,3 (x)\nq\n\nr", "<|endoftext|> z", "a\x1cb c\x85 d"]
    assert all(e.encode(t) == np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)


@pytest.mark.parametrize("planes", [4, 32])
def test_token_ids(spark, docs, rows, none, planes):
    got = {r["doc_id"]: r for r in token_output.token_ids(docs, planes=planes).collect()}
    start = len(encoded("a row without an id", 2))
    for i, t in sorted(rows):
        ids = encoded(t, 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_output.token_ids(none).count() == 0


def test_shards():
    ids = np.arange(40_000, dtype="<u4") * 7
    for planes in (4, 32):
        counts, back = token_output.read_shard(token_output.write_shard([10, 0, 39_990], ids.tobytes(), planes, 1000))
        assert counts.tolist() == [10, 0, 39_990] and back == ids.tobytes()
    with pytest.raises(ValueError):
        token_output.read_shard(b"XXXX" + bytes(40))


def test_packing(spark, docs, rows, none):
    out = packing.pack(docs, sequence=64, window_sequences=4).toPandas()
    texts = {i: encoded(t, 1) for i, t in rows}
    for i, own in out[out.doc_id.notna()].sort_values("start").groupby("doc_id"):
        at, ids = 0, texts[i]
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all() and s.length.sum() <= 64
    assert out.length.sum() > 64 * (out.sequence_id.nunique() - 1) and out.sequence_id.max() + 1 == out.sequence_id.nunique()
    share = out.groupby(out.source.fillna("-")).length.sum() / out.length.sum()
    window = out[out.sequence_id // 4 < out.sequence_id.max() // 4].groupby([out.sequence_id // 4, out.source.fillna("-")]).length.sum().unstack(fill_value=0)
    assert (abs(window - share * 256) <= 4).all().all()  # every window holds the target proportions
    assert packing.pack(none).count() == 0


def test_given_shares():
    m = np.arange(0, 1001)
    out = packing.given(m, [700, 1, 299])
    assert (out.sum(axis=0) == m).all() and (np.diff(out, axis=1) >= 0).all() and out[:, -1].tolist() == [700, 1, 299]
    assert (packing.given(np.array([10**18]), [10**18, 10**18])[:, 0] == 5 * 10**17).all()


def test_components(spark):
    pick = random.Random(1)
    edges = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == r for x, r in root.items())


def shingle_set(text, n):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize(("size", "percent", "group"), [(4, 85, 64), (2, 60, 3)])
def test_ngram_join(spark, docs, rows, none, size, percent, group):
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in ngram_join.classes(docs, size, percent, group).collect()}
    assert {i: (len(sets[i]), root[i]) for i in sets} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None}
    assert got[None]["component_id"] is None
    assert ngram_join.classes(none).count() == 0


def test_one_of_each(spark, docs, rows):
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.select("doc_id").collect()}
    assert None in kept and not kept & set(range(200, 205)) and set(range(60)) <= kept


def late_lines(rows):
    """(doc_id, line number) of lines that an earlier line matches."""
    seen, late = [], set()
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = set(WORDS.findall(line.lower()))
            if s and any(9 * len(s & x) >= 4 * (len(s) + len(x)) for x in seen):
                late.add((i, k))
            if s:
                seen.append(s)
    return late


@pytest.mark.parametrize("crowd", [512, 20])
def test_line_dedup_of_real_documents(spark, crowd):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = late_lines([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    got = [(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame, crowd=crowd).collect()]
    assert len(expected) == 318 and len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("crowd", [512, 5, 1])
def test_line_dedup(spark, rows, none, crowd):
    """Equal to brute force, with all tokens paired alone (512), and with crowds of tokens and of their pairs (5, 1)."""
    more = [*rows, (950, "one two three four five six seven eight nine ten\n\nshort line\nshort line"), (951, "zero one two three four five six seven eight nine ten\nSHORT line"), (952, "\n".join("the of and in to " + " ".join(f"v{k}{j}" for j in range(k % 3)) for k in range(40)))]
    more += [(1000 + k, " ".join(f"q{j}" for j in range(20) if j != k % 20) + f" u{k}") for k in range(60)]
    frame = documents(spark, more).repartition(3)
    expected = late_lines(more)
    removed = line_dedup.removed_lines(frame, cells=1 << 10, crowd=crowd)
    assert {(r["doc_id"], r["line_no"]) for r in removed.collect()} == expected and (951, 0) in expected
    if crowd < 512:
        return
    out = {r["doc_id"]: r for r in line_dedup.without_lines(frame, removed).collect()}
    assert len(out) == len(more) and set(out[950].asDict()) == set(frame.columns)
    assert out[950]["text"] == "one two three four five six seven eight nine ten\n\nshort line" and out[951]["text"] == "" and out[951]["n_chars"] == 0
    assert out[900]["text"] is None
    assert line_dedup.removed_lines(none).count() == 0


def test_quality(spark, docs, rows, none, monkeypatch):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows) + 1
    for i, t in rows:
        t = t or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, inside = Counter(windows), set()
        for k, x in enumerate(windows):
            if count[x] > 1:
                inside.update(range(k, k + 8))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    monkeypatch.setattr(quality, "LANGUAGES", 1)  # a block for each language, common words joined by a shuffle
    assert {r["doc_id"]: r for r in quality.judge(docs).collect()} == got
    long = {r["doc_id"]: r for r in quality.judge(documents(spark, [(1, "x" * 200_000), (2, "y " * 60 + "z" * 100_000)])).collect()}
    assert (long[1]["n_words"], long[1]["word_chars"], long[1]["kept"]) == (1, 200_000, False) and long[2]["n_words"] == 61
    assert quality.judge(none).count() == 0
    twice = quality.judge(docs.unionByName(docs)).groupBy("doc_id").agg(F.count_distinct("distance").alias("n"), F.max("distance").alias("d"))
    assert all(r["n"] <= 1 and r["d"] == got[r["doc_id"]]["distance"] for r in twice.collect() if r["doc_id"] in range(60))


def test_quality_drops_noise(spark):
    pick = random.Random(3)
    plain = [(i, " ".join(pick.choice(["the", "of", "and", "house", "tree", "river", "walks"]) for _ in range(80))) for i in range(1, 80, 2)]
    noise = " ".join("".join(pick.choice("#*%&XQZ09") for _ in range(6)) for _ in range(80))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, [*plain, (501, noise)])).collect()}
    assert not got[501] and all(got[i] for i, _ in plain)


def test_decontamination(spark, rows, none):
    item = "On Monday Alice drove 120 miles from Oslo and then another 30 miles past the old mill before she met Bob for lunch"
    items = spark.createDataFrame([(1, item), (2, "short item about gardens"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    texts = {
        300: f"Intro words here. {item} and more text", 301: item.replace("120", "450").replace("30", "77").replace("Alice", "Maria"),
        302: item.replace("30 miles", "120 miles"), 303: "It is a SHORT item about gardens, really.", 304: "short item about rivers", 305: "from Oslo and then another",
    }
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(documents(spark, [*rows, *texts.items()]), items).collect()}
    assert {(300, 1), (301, 1), (303, 2)} <= set(got) and not {d for d, _ in got} & {304, 305} and not {d for d, _ in got} & {i for i, _ in rows}
    assert got[300, 1]["exact"] > 0 and got[301, 1]["n_windows"] >= 5
    assert (302, 1) not in got or got[302, 1]["n_windows"] < got[300, 1]["n_windows"]  # 120 and 30 became one value
    frame = documents(spark, [*texts.items(), (None, item)])
    left = decontam.without_benchmark(frame, items)
    assert left.columns == frame.columns and {304, 305} <= {r["doc_id"] for r in left.collect()} and not {300, 303, None} & {r["doc_id"] for r in left.collect()}
    assert decontam.matches(none, items).count() == 0 and decontam.matches(frame, items.limit(0)).count() == 0


def test_token_counts(spark, docs, rows, none):
    scores, longest = token_counts.piece_scores(vocabulary("piece_bpe_32k.model"))

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + token_counts.UNKNOWN, best[end - 1][1] - len(word[end - 1].encode()))]
            options += [(best[k][0] + scores[word[k:end]], best[k][1] - 1) for k in range(end) if word[k:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, slice_rows=7).collect()}
    for i, t in rows:
        words = WORDS.findall(t or "")
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(map(brute, (token_counts.MARK + w for w in words)))) or len(words) > 5000
    assert token_counts.token_counts(none).count() == 0
    by = {r["source"]: r["n_docs"] for r in token_counts.corpus_token_counts(token_counts.token_counts(docs), docs).collect()}
    assert sum(by.values()) == len(rows)


def test_warc(spark, none):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "u1", big, "x"), (5, "u5", big, "x"), (2, "u2", big, "x"), (3, "u3", "small", "x"), (4, "u4", "small", "x"), (6, None, None, "x"), (7, "u7", "", "x")], "page_id long, url string, html string, address string")
    got = {r["page_id"]: r for r in warc.archived_pages(pages).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert got[1]["payload_bytes"] == 1200 and got[6]["payload_digest"] == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 3
    records = {r["page_id"]: bytes(r["record"]) for r in warc.record_bytes(warc.read_archive(archive)).collect()}
    assert records[5].startswith(b"WARC/1.1\r\nWARC-Type: response") and records[5].endswith("é".encode() + b"\r\n\r\n") and b"Refers-To: <urn:page:5>" in records[1]
    damaged = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(damaged).collect()
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_digests(damaged).collect()
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_languages(spark, docs, rows, none):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(frame).join(frame.select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) + 1 and {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[900]["score"] == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(none).count() == 0


def test_toxicity(spark, docs, rows, none):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.classify(frame, labels).join(labels, "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.93
    own = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, own).collect()}
    assert len(got) == len(rows) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert {r["score"] for r in toxicity.classify(docs, own.where("toxic = 0")).collect()} == {0.0}
    clean = toxicity.keep_clean(docs, own.limit(0))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert toxicity.classify(none, own).count() == 0
