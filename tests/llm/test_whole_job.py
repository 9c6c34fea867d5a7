"""Cases where an operator once did less than the whole job."""

from collections import Counter

from pyspark.sql import functions as F

from mailprism.llm import sharding
from mailprism.operators import corpus, ml
from mailprism.plans.registry import REGISTRY


def test_shards_of_copies_reach_the_lower_bound(spark):
    n, k = 8000, 40
    texts = ["big"] * (n // 3) + [f"pair {i // 2}" for i in range(n * 3 // 10)] + [f"ten {i // 10}" for i in range(n * 3 // 10)]
    texts += [f"own {i}" for i in range(n - len(texts))]
    placed = sharding.place(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    assert [r["count"] for r in placed.groupBy("shard").count().collect()] == [n // k] * k
    least = sum(-(-m // (n // k)) - 1 for m in Counter(texts).values())
    assert sharding.cut_edges(None, placed).first().cuts <= least + k


def test_simhash_reads_whole_texts():
    opening = " ".join(f"word{i}" for i in range(80))
    a, b = (f"{opening} {' '.join(f'{x}{i}' for i in range(400))}" for x in "ab")
    assert corpus.simhash_of(a, 80) == corpus.simhash_of(b, 80) == corpus.simhash_of(opening)
    assert bin((corpus.simhash_of(a) ^ corpus.simhash_of(b)) & (1 << 64) - 1).count("1") > 5
    assert bin((corpus.simhash_of(a) ^ corpus.simhash_of("header " + a)) & (1 << 64) - 1).count("1") <= 5


def test_text_classifier_scores_every_document(spark, sf):
    import mailprism.plans.catalog  # noqa: F401

    got = REGISTRY["ml_tfidf_lr"].run(spark, sf).collect()
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.label == known.get(r.doc_id) and r.p is not None for r in got)


def test_every_source_is_left_out_once(spark):
    rows = spark.createDataFrame([(s, float(i), i % 2) for s in ("de", "it", None) for i in range(10)], "lang string, x double, y int")
    fit = lambda rows: lambda df: df.withColumn("prediction", F.col("x") % 2)
    assert {r.source for r in ml.leave_source_out(rows, "lang", fit, "y", "prediction").collect()} == {"de", "it", None}
