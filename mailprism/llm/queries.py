"""The queries of this subpackage, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, jaccard, language, mixing, quality, sharding, tokenfile, urls, warc
from .common import table


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    model = language.fit(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    )
    return judged.drop("text").withColumn("score", F.round("score", 9))


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.fit(urls.labelled_urls()))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(manifest)


QUERIES = {f.__name__: f for f in (op1_entropy_mix, op2_url_filter, op3_posting_lists, op4_byte_bpe, op5_ngram_jaccard_join, op6_balanced_shards, op7_token_file, op8_language_id, op9_warc, op10_quality_rules)}

#: Where SQL can express the whole result. The others hold a fitted model or a free choice; tests have brute force for them.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        l as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as l from w),
        s as (select doc_id, unnest(l) as g from l), n as (select doc_id, len(l) as n from l),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        k as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)), e as (select a, b from k union all select b, a from k),
        r(doc_id, seen) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.seen), m as (select doc_id, min(seen) as component_id from r group by 1),
        d as (select doc_id, min(doc_id) over (partition by list_sort(l)) as class_id, len(l) as len from l)
        select doc_id, len::bigint as n_shingles, case when len = 0 then doc_id else class_id end as class_id, component_id from d join m using (doc_id)""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as payload from pages), h as (select *, sha1(payload) as x, max(page_id) over (partition by payload) as first from p)
        select page_id, octet_length(encode(payload))::bigint as payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i // 4 * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::bigint, 1)), '') as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from h""",
}
