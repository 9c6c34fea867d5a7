"""Queries of diagnostics: models of features of documents, learned on one language and held against the others."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import diagnostics, features, ml
from .registry import query, settled


def _features(t):
    """(features with y, names): y is 0 for good documents, 2 for bad ones, 1 for bad ones of few characters."""
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id").withColumn("body_text", F.col("text"))
    y = F.when(F.col("quality") == 1, 0).when(F.col("n_chars") % 3 == 0, 1).otherwise(2)
    f = settled(features.extract(d.withColumn("y", y), ["doc_id", "lang", "y"]))
    return f, features.names()


def _parts(f):
    home = F.coalesce(F.col("lang") == "en", F.lit(False))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return f.filter(home & ~third), f.filter(home & third), f.filter(~home)


def _model(rows, names, y):
    asm = VectorAssembler(inputCols=names, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(asm.transform(rows))
    lr = LogisticRegression(featuresCol="_x", labelCol=y, probabilityCol="_p", maxIter=25, regParam=1e-3)
    return asm, scaler, lr.fit(scaler.transform(asm.transform(rows)))


def _fit(rows, names, y):
    asm, scaler, model = _model(rows, names, y)
    scored = lambda df: model.transform(scaler.transform(asm.transform(df)))
    p = vector_to_array("_p")
    return lambda df: scored(df).select(y, F.col("prediction").cast("int").alias("pred"), F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)).alias("score"))


@query("feature_subsets", "ML-11 FP-09")
def feature_subsets(t):
    f, names = _features(t)
    train, test, holdout = _parts(f)
    drift = {r["feature"]: r["psi"] for r in diagnostics.psi_of_all(train, holdout, names).collect()}  # a row a feature
    weights = abs(_model(train, names, "y")[2].coefficientMatrix.toArray()).max(axis=0)
    return diagnostics.generalization(train, test, holdout, diagnostics.subsets(names, drift, dict(zip(names, weights))), _fit)


@query("binary_diagnostics", "ML-10 AG-54 AG-57")
def binary_diagnostics(t):
    f, names = _features(t)
    views = {"threat": lambda df: df.withColumn("y", diagnostics.threat(F.col("y"))), "phishing": lambda df: diagnostics.phishing_or_legitimate(df, "y")}
    return diagnostics.binary_gaps(views, *_parts(f), [n for n in names if n.startswith(diagnostics.MESSAGE)], _fit)


@query("feature_groups_left_out", "ML-07 WN-11 FP-09")
def feature_groups_left_out(t):
    f, names = _features(t)
    train, test, _ = _parts(f)

    def score(kept):
        return diagnostics.generalization(train, test, test, {"kept": kept}, _fit).first()["test_macro_f1"]

    rows = ml.leave_out(["msg_", "cnt_", "bec_"], score, [n for n in names if n.startswith(diagnostics.MESSAGE)])
    return f.sparkSession.createDataFrame([(i + 1, g, round(s, 6), round(d, 6)) for i, (g, s, d) in enumerate(rows)], "rank int, left_out string, macro_f1 double, fall double")


@query("calibration_choice", "ML-04 AG-25 AG-27")
def calibration_choice(t):
    f, names = _features(t)
    binary = f.withColumn("y", diagnostics.threat(F.col("y")))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    model = _fit(binary.filter(third == 0), [n for n in names if n.startswith(("msg_", "cnt_"))], "y")
    return diagnostics.calibrations(settled(model(binary.filter(third == 1))), settled(model(binary.filter(third == 2))), "score", "y")


@query("drift_of_all", "AG-37 AG-40", """
    with x as (select l_returnflag as f, unnest(['l_quantity', 'l_discount', 'l_tax']) as feature, unnest([l_quantity::double, l_discount::double, l_tax::double]) as v from lineitem where l_returnflag in ('N', 'R')),
    q as (select feature, quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as c from x where f = 'N' group by 1),
    b as (select feature, len(list_filter(c, lambda e: e < v)) as bin, count(*) filter (where f = 'N') as e, count(*) filter (where f = 'R') as a from x join q using (feature) group by 1, 2),
    s as (select feature, sum(e) as te, sum(a) as ta from b group by 1), p as (select feature, greatest(e / te, 1e-4) as e, greatest(a / ta, 1e-4) as a from b join s using (feature))
    select feature, round(sum((a - e) * ln(a / e)), 6) as psi from p group by 1""")
def drift_of_all(t):
    line = t("lineitem")
    return diagnostics.psi_of_all(line.filter("l_returnflag = 'N'"), line.filter("l_returnflag = 'R'"), ["l_quantity", "l_discount", "l_tax"])
