"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import collocations, decontam, hard_negatives, langid, line_dedup, ngram_join, packing, quality, token_counts, token_output, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows hold sources by the power 0.7 of their tokens, as long as these last."""
    return packing.pack(_read(spark, sf_dir, "documents"), temperature=0.7)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_read(spark, sf_dir, "pages"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_ids(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_toxicity, op4_warc, op5_langid, op6_ngram_join, op7_token_output, op8_quality, op9_decontamination, op10_token_counts, op11_hard_negatives, op12_top_k, op13_collocations)}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) b from pages),
        d as (select page_id, octet_length(b) n, sha1(b) h from p),
        k as (select *, max(page_id) over (partition by h) top from d)
        select page_id, n as payload_bytes, h as payload_digest,
               case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> top then top end as refers_to
        from k""",
    "op11_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) q
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, list_dot_product(a.q, c.q)::bigint as score
            from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
        p as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where alike
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (
            select p.*, s.vec_id as negative_id, s.score as negative_score,
                   row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
            from p join s using (anchor_id) where not alike and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
               dense_rank() over (partition by anchor_id order by positive_score desc, positive_id)::int as positive_rank
        from n where rank <= 10""",
    "op12_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) q
            from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
        select a.vec_id as query_id, row_number() over (partition by a.vec_id order by list_dot_product(a.q, c.q) desc, c.vec_id)::int as rank,
               c.vec_id, list_dot_product(a.q, c.q)::bigint as score
        from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
        qualify rank <= 10""",
    "op13_collocations": r"""
        with d as (
            select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
        p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from d),
        w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w from p),
        g as (
            select lang, 1 as k, unnest(w) as phrase from w
            union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
            union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
        f as (select lang, k, phrase, count(*) as a from g group by all),
        c as (select *, string_split(phrase, ' ') s from f where k > 1 and a >= 10),
        cut as (
            select lang, phrase, a, 1 as first_words, s[1] as x, array_to_string(s[2:], ' ') as y from c
            union all select lang, phrase, a, 2, s[1] || ' ' || s[2], s[3] from c where k = 3),
        scored as (
            select cut.*, x.a as l, y.a as r, (1000000::hugeint * cut.a * cut.a) // (x.a::hugeint * y.a) as score
            from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y),
        low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, first_words) = 1),
        kept as (
            select * from low where not exists (
                select 1 from c where c.k = 3 and c.lang = low.lang and c.phrase <> low.phrase and 100 * c.a >= 50 * low.a
                and (c.s[1] || ' ' || c.s[2] = low.phrase or c.s[2] || ' ' || c.s[3] = low.phrase)))
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
               (select sum(a) from f where f.k = 1 and f.lang = kept.lang)::bigint as n, score::bigint as score
        from kept qualify rank <= 2000""",
}
