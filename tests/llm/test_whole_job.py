"""What the registered queries must do over the whole of their job."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hirelens.llm import packing, queries, warc
from hirelens.llm.chunks import encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, tmp_path, rows):
    """A folder with these (doc_id, text, source) as its documents table."""
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lines_match_by_words(spark, tmp_path):
    pick = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    rows = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "s"), (1, "Alpha beta gamma delta CHANGED zeta eta theta iota kappa\nalpha beta gamma delta", "s")]
    rows += [(k, "\n".join(" ".join(pick.sample(words, pick.randint(1, 36))) for _ in range(4)), "s") for k in range(2, 80)]
    seen, expected = [], set()
    for i, t, _ in rows:
        for k, line in enumerate(t.split("\n")):
            s = set(line.lower().split())
            if any(9 * len(s & x) >= 4 * (len(s) + len(x)) for x in seen):
                expected.add((i, k))
            seen.append(s)
    sf = documents(spark, tmp_path, rows)
    got = {(r["doc_id"], r["line_no"]) for r in queries.op1_line_dedup(spark, sf).collect()}
    assert got == expected and (1, 0) in got and (1, 1) not in got
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert left[1] == "alpha beta gamma delta"


def test_archive_is_read_back(spark, tmp_path, monkeypatch):
    big = "x" * 1500
    rows = [(1, "u1", big), (5, "u\r\nWARC-Refers-To: <urn:page:77>\r\n", big), (2, "u2", "small"), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op4_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (1500, "revisit", 5), 5: (1500, "response", None), 2: (5, "response", None), None: (0, "response", None)}
    write = warc.write_archive
    header = F.col("header")
    for bad in (F.replace(header, F.lit("WARC-Type: revisit"), F.lit("WARC-Type: response")), F.replace(header, F.lit("<urn:page:2>"), F.lit("<urn:page:3>")), F.replace(header, F.lit("Length: 5"), F.lit("Length: 6")), F.substring(header, 3, 5000)):

        def damaged(pages, least, bad=bad):
            archive = write(pages, least)
            return warc.Archive(archive.headers.withColumn("header", bad), archive.payloads)

        monkeypatch.setattr(warc, "write_archive", damaged)
        with pytest.raises(Exception, match="damaged header"):
            queries.op4_warc(spark, str(tmp_path)).collect()


def fresh_ids(text, end):
    """The ids by the library as it comes."""
    return np.array([*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_added_tokens_are_encoded_as_the_library_does(spark, tmp_path):
    texts = ["a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", "x  y <|endoftext|> z", "plain words, no literal", "half <|endof text|> of it", None]
    assert [np.frombuffer(encoder(vocabulary()).encode(t), "<u4").tolist() for t in texts] == [fresh_ids(t, 0)[:-1].tolist() for t in texts]
    sf = documents(spark, tmp_path, [(k, t, "s") for k, t in enumerate(texts)])
    written = {r["doc_id"]: r for r in queries.op7_token_output(spark, sf).collect()}
    packed = {r["doc_id"]: r for r in queries.op2_packing(spark, sf).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = fresh_ids(t, 2)
        assert (written[k]["start"], written[k]["n_tokens"], written[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        assert (packed[k]["doc_tokens"], packed[k]["ids_crc32"]) == (len(ids), zlib.crc32(fresh_ids(t, 1).tobytes()))


def test_other_vocabularies_are_encoded_whole():
    """Texts are cut at spaces only for the pre-tokenizer that allows it."""
    path = vocabulary("word_bpe_49k.json")
    of = encoder(path)
    assert encoder(vocabulary()).cuts and not of.cuts
    for text in ["plain words here", "x  y", "Größe, 12 and", ""]:
        assert np.frombuffer(of.encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_any_number_of_sources_is_packed(spark, tmp_path):
    """Over 400 sources: the large ones hold the mixture, the others share queues, and all ids are packed once."""
    rows = [(k, f"text {k} " * (k % 7), None if k % 401 == 400 else f"s{k % 401}") for k in range(1300)] + [(2000 + k, "a longer document of a large source " * 40, f"s{k % 2}") for k in range(20)]
    sf = documents(spark, tmp_path, rows)
    out = packing.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), sequence=64, window_sequences=8).toPandas()
    source, texts = {i: s for i, _, s in rows}, {i: t for i, t, _ in rows}
    for i, own in out.sort_values("start").groupby("doc_id"):
        at, ids = 0, np.array([*encoder(vocabulary()).whole.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32 and (p.source or None) == source[i]
            at += p.length
        assert at == len(ids)
    assert set(out.doc_id) == set(source)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all()
    assert out.length.sum() > 64 * out.sequence_id.max() and out.groupby("sequence_id").length.sum().max() == 64
    window = out[out.sequence_id // 8 < out.sequence_id.max() // 8]
    large = window[window.source == "s0"].groupby(window.sequence_id // 8).length.sum()
    assert (abs(large - 512 * out[out.source == "s0"].length.sum() / out.length.sum()) <= 2).all()
    assert len(queries.op2_packing(spark, sf).select("doc_id").distinct().collect()) == len(rows)


def test_line_dedup_filters_long_lines_and_hashes_texts_once(spark):
    """Sets of 100 words of which over 22 differ for sure are no candidates; a text is not carried along with each of its lines."""
    from hirelens.llm import line_dedup

    side = lambda name, low, high: spark.createDataFrame([(100, 0, low, high)], "n int, at int, low long, high long").alias(name)
    for turned, expected in (((1 << 22) - 1, 1), ((1 << 23) - 1, 0)):  # 22 tokens may differ
        assert side("a", 0, 0).crossJoin(side("b", 0, turned)).where(line_dedup._like()).count() == expected
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    assert line_dedup.lines_of(docs).count() == 2
    plan = line_dedup.lines_of(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("xxhash64" in x for x in plan[: next(i for i, x in enumerate(plan) if "Generate" in x)])


def test_warc_reads_without_a_shuffle(spark):
    """The archive is bucketed by address: reading it moves neither headers nor payloads."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([(k, f"u{k}", "x" * (1000 + k // 2)) for k in range(40)] + [(None, None, None)], "page_id long, url string, html string")
        read = warc.archived_pages(pages)
        assert read.count() == 41 and read.where("record_type = 'revisit'").count() == 20
        assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_encoder_keeps_a_bounded_number_of_chunks(spark, monkeypatch):
    """Few kept chunks change no id, not even a text of many words passes the bound, and the pipeline keeps fewer than packing alone."""
    from hirelens.llm import chunks

    small, text = chunks.encoder(vocabulary(), 50), " ".join(f"w{k % 333}x" for k in range(2000))
    assert small.encode(text) == chunks.encoder(vocabulary()).encode(text) and 0 < len(small.kept) <= 50
    asked = []
    monkeypatch.setattr(packing, "encode_documents", lambda docs, end_id, path, kept: asked.append(kept) or docs.limit(0).selectExpr("0 part", "source", "0L before", "doc_id", "0L n", "binary(text) ids"))
    assert corpus_pipeline.pack(spark, spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA), "").count() == 0
    assert asked == [corpus_pipeline.KEPT] and corpus_pipeline.KEPT < chunks.KEPT


def test_line_dedup_cuts_words_at_single_spaces(spark):
    """Words are cut at a lone space, without a pattern; other ASCII blanks count all the same, and no others do."""
    import re

    from hirelens.llm import line_dedup

    lines = ["A b", " a  b ", "a\tb\x0bC\x0cd\re", "\t \r", "", "a\xa0b\x1cc\x85d  e", "ÄB \tçÉ", "no\x00\x08\x0e cut", None]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").select("k", line_dedup.words_of_line().alias("w"))
    assert [r["w"] for r in frame.orderBy("k").collect()] == [None if x is None else [w for w in re.split("[\x20\x09-\x0d]+", x.lower()) if w] for x in lines]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"split\(.*,  , -1\)", plan), plan
    docs = spark.createDataFrame([(1, "a\tb\nB  a"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(line_dedup.rarity(docs, 1 << 10))[-3:] == [0, 15, 15]  # two words twice each, nothing for what stands between blanks
