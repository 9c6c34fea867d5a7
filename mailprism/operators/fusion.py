"""Comparison of fusion strategies: measures of three-class predictions, a learned strategy, degraded evidence, cases to read.

Rows hold p and q, the forensic and the semantic distribution as arrays over scoring.CLASSES, and y, the class number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import ml, scoring

Change = Callable[[DataFrame], DataFrame]

# Prefixes of features that each condition of evidence takes away, and what a short body is cut to.
STRIPPED = {"no_authentication": ["auth_"], "no_relay": ["relay_"], "no_ip": ["ip_"], "no_domain": ["dom_"], "no_url": ["url_"], "no_attachment": ["att_"], "no_headers": ["hdr_", "relay_", "auth_", "ident_"]}
SHORT_BODY = {"msg_body_word_count": 10.0, "msg_body_length": 60.0, "msg_body_line_count": 2.0}
HOLDOUT = ["hdr_", "auth_", "relay_", "ip_", "dom_", "url_", "att_", "ident_"]


def class_of(p: Column) -> Column:
    """Number of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def measures(pred: Column, y: Column, prefix: str = "") -> list[Column]:
    """Aggregates: accuracy, macro F1, F1 of phishing and recall of legitimate; absent classes count 0. One pass of counts."""
    tp = [F.count_if((pred == c) & (y == c)) for c in range(3)]
    said, true = [F.count_if(pred == c) for c in range(3)], [F.count_if(y == c) for c in range(3)]
    f1 = [F.coalesce(F.try_divide(2 * tp[c], said[c] + true[c]), F.lit(0.0)) for c in range(3)]
    named = {"accuracy": F.try_divide(sum(tp[1:], tp[0]), F.count(y)), "macro_f1": sum(f1[1:], f1[0]) / 3, "phishing_f1": f1[2], "legitimate_recall": F.coalesce(F.try_divide(tp[0], true[0]), F.lit(0.0))}
    return [F.round(v, 6).alias(prefix + k) for k, v in named.items()]


def learned(rows: DataFrame, meta: str, y: str) -> Callable[[DataFrame], DataFrame]:
    """Fits a logistic regression with balanced classes to arrays of meta features; returns what adds `learned`, an array.
    The penalty is that of one unit over all rows, on the features as they are."""
    fit = ml.balanced(rows.withColumn("_x", array_to_vector(meta)), y)
    model = LogisticRegression(featuresCol="_x", labelCol=y, weightCol="weight", probabilityCol="_p", maxIter=200, regParam=1 / max(1, rows.count()), standardization=False, family="multinomial").fit(fit)
    return lambda df: model.transform(df.withColumn("_x", array_to_vector(meta))).withColumn("learned", vector_to_array("_p")).drop("_x", "_p", "rawPrediction", "prediction")


def compared(rows: DataFrame, distributions: dict[str, Column], y: str) -> DataFrame:
    """Measures and mean confidence by strategy, in one pass over rows."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("p")) for k, v in distributions.items()]))
    r = rows.select(F.col(y).alias("_y"), each.alias("x")).select("_y", "x.*")
    return r.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *measures(class_of(F.col("p")), F.col("_y")), F.round(F.avg(F.array_max("p")), 6).alias("mean_confidence"))


def conditions(names: list[str]) -> dict[str, Change]:
    """Ten states of evidence as changes of feature columns; -1 stands for absent."""

    def strip(prefixes: list[str]) -> Change:
        return lambda df: df.withColumns({n: F.lit(-1.0) for n in names if n.startswith(tuple(prefixes))})

    def holdout(df: DataFrame) -> DataFrame:
        return strip(HOLDOUT)(df).withColumns({n: F.lit(0.0) for n in names if n == "msg_header_count"})

    short = {n: F.least(F.col(n), F.lit(v)) for n, v in SHORT_BODY.items() if n in names}
    return {"full": lambda df: df} | {k: strip(v) for k, v in STRIPPED.items()} | {"short_body": lambda df: df.withColumns(short), "holdout": holdout}


def degradation(features: DataFrame, names: list[str], predict: Change) -> DataFrame:
    """A row a condition: mean quality and weight, measures of both models and their fusion, and how much more accurate the
    fusion is. features: y, q and the columns `names`; predict adds p, the forensic distribution, to changed features.
    Text is as it was, so q does not change."""
    out = None
    for name, change in conditions(names).items():
        e = scoring.evidence_quality(predict(change(features)), names, ["y", "p", "q"]).select(F.lit(name).alias("condition"), "y", "p", "q", "quality")
        out = e if out is None else out.unionByName(e)
    a = scoring.alpha(F.col("quality"))
    p, q = [F.col("p")[i] for i in range(3)], [F.col("q")[i] for i in range(3)]
    rows = out.withColumn("alpha", a).withColumn("f", F.array(*scoring.fused(p, q, F.col("alpha"))))
    y, agg = F.col("y"), []
    for k, c in (("forensic_", "p"), ("semantic_", "q"), ("fused_", "f")):
        agg += measures(class_of(F.col(c)), y, k)
    r = rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 4).alias("mean_quality"), F.round(F.avg("alpha"), 4).alias("mean_alpha"), *agg)
    return r.withColumns({"over_forensic": F.round(F.col("fused_accuracy") - F.col("forensic_accuracy"), 4), "over_semantic": F.round(F.col("fused_accuracy") - F.col("semantic_accuracy"), 4)})


def case_studies(rows: DataFrame, key: str, text: str, each: int = 2, shown: int = 250) -> DataFrame:
    """The first `each` rows by key of every kind of disagreement, with the start of the text and a diagnosis.

    rows: key, text, p, q, f (the fused distribution) and y, null where unknown. FORENSIC or SEMANTIC: that model and the
    fusion are right; COMPLEMENTARY: the fusion alone is; else AMBIGUOUS. The rank is cut before the shuffle.
    """
    name = lambda c: F.element_at(F.array(*map(F.lit, scoring.CLASSES)), c + 1)
    a, b, f, y = class_of(F.col("p")), class_of(F.col("q")), class_of(F.col("f")), F.col("y")
    right = F.coalesce(f == y, F.lit(False))
    diagnosis = F.when(right & (a == y), "FORENSIC").when(right & (b == y), "SEMANTIC").when(right, "COMPLEMENTARY").otherwise("AMBIGUOUS")
    snippet = F.trim(F.replace(F.substring(F.coalesce(text, F.lit("")), 1, shown), F.lit("\n"), F.lit(" ")))
    r = rows.filter(a != b).select(key, scoring.disagreement(name(a), name(b)).alias("category"), name(y).alias("truth"), name(f).alias("fused"), diagnosis.alias("diagnosis"), snippet.alias("snippet"))
    return r.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(key))).filter(F.col("rank") <= each)
