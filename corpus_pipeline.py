"""A corpus pipeline of operators from mailprism.llm: each stage's rows are written and read again by the next one.

Every stage reads whole texts of any length and takes an empty table to an empty one. All but the last return the columns
of docs, whatever their types, and leave extra columns as they are; names that begin with `_mp_` are reserved. Null and
empty texts fail the first stage's rule on length. What else a stage does with nulls and repeated rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailprism.llm import bpe, jaccard, language, mixing, quality
from mailprism.llm.common import by_ids, compact, settled, table

#: Language ID rejects a text without a letter, and one whose language is less certain than this.
LEAST_LANGUAGE_SCORE = 0.4

#: Words that a stage keeps in a worker. Less than alone: workers and executors live through all stages here.
CACHED = 75_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep; each of several equal rows, also those without doc_id."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language; fitted to all of the stage's own rows, without the held-out fold.

    Null lang teaches nothing; such rows are judged like others. Without any lang nothing can be told: all are dropped.
    """
    held_out = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    model = language.fit_all(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    judged = language.identify(docs, model, language.LanguageModel(cached=CACHED), names=("_mp_lang", "_mp_score"))
    kept = (F.col("_mp_lang") != "und") & (F.col("_mp_score") >= LEAST_LANGUAGE_SCORE)
    return judged.filter(kept).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once.

    Of rows that repeat a doc_id the one with the smallest text stays, null texts last; of equal texts the row with the
    smallest hash of its other columns. Rows without doc_id are in no group and all stay.
    """
    joined = jaccard.join(docs)
    gone = compact(joined.filter("doc_id <> component_id").select("doc_id"), "pipeline-gone")
    kept = by_ids(docs, gone, "doc_id", "left_anti")
    again = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    again = compact(again, "pipeline-repeated")
    n = again.count()
    if not n:
        return kept
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(*plain))
    repeated = by_ids(kept, again, "doc_id", "left_semi", n).groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("_mp_row"))
    return by_ids(kept, again, "doc_id", "left_anti", n).unionByName(repeated.select("_mp_row.*"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Null source is a source; a document without a word goes."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of each row, one for each copy."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, cached=CACHED)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The learned stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs, f"pipeline-{name}")
    return docs
