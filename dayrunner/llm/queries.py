"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrunner.llm import (
    bpe,
    collocations,
    contexts,
    exact_dedup,
    fim,
    langid,
    licenses,
    minhash,
    mixing,
    partitions,
    pii,
    quality,
    spans,
)
from dayrunner.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda s: s["family"])))
    return found.select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"),
        F.round(F.array_min(F.transform("licences", lambda s: s["probability"])), 6).alias("least_probability"), "n_unknown")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.search(table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80).drop("n_links")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.learn(docs, labels))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.score(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_licences, op2_mixing, op3_learned_partitions, op4_personal_data, op5_byte_bpe, op6_minhash, op7_language_id,
        op8_sentence_spans, op9_exact_dedup, op10_quality, op11_collocations, op12_context_tree, op13_fill_in_middle,
    )
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op11_collocations": collocations.oracle(),
    "op13_fill_in_middle": fim.oracle(),
    "op9_exact_dedup": """
        with d as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
            doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
        from d window w as (partition by norm)
    """,
    "op6_minhash": """
        with w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
            from documents
        ), s as (
            select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
                else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as sh
            from w
        ), n as (
            select w.doc_id, count(s.sh) as n_shingles from w left join s using (doc_id) group by 1
        ), f as (
            select sh, count(*) as df from s group by 1
        ), r as (
            select doc_id, sh, row_number() over (partition by doc_id order by df, sh) as pos, n_shingles
            from s join f using (sh) join n using (doc_id)
        ), p as (
            select * from r where 100 * (pos - 1) <= 20 * n_shingles
        ), c as (
            select distinct a.doc_id as a, b.doc_id as b, a.n_shingles as na, b.n_shingles as nb
            from p a join p b on a.sh = b.sh and a.doc_id < b.doc_id
                and 100 * least(a.n_shingles, b.n_shingles) >= 80 * greatest(a.n_shingles, b.n_shingles)
        ), l as (
            select c.a, c.b from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and x.sh = y.sh
            group by c.a, c.b, c.na, c.nb having 100 * count(*) >= 80 * (c.na + c.nb - count(*))
        ), e as (
            select a, b from l union all select b, a from l
        ), reach as (
            with recursive t(a, b) as (
                select doc_id, doc_id from n union select t.a, e.b from t join e on t.b = e.a
            ) select a, min(b) as component_id from t group by 1
        )
        select n.doc_id, n.n_shingles, component_id, n.doc_id = component_id as kept
        from n join reach on reach.a = n.doc_id
    """,
}
