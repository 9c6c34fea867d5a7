"""How well a classifier of features carries over: feature subsets, binary views, groups left out, choice of calibration.

Features are columns named by the prefix of their group; y is the class number over scoring.CLASSES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import fusion, metrics, ml

Fit = Callable[[DataFrame, list[str], str], Callable[[DataFrame], DataFrame]]

# Groups of features that the subsets take.
NETWORK = ("auth_", "ident_", "relay_", "ip_", "hdr_")
CONTENT = ("dom_", "url_", "cnt_")
MESSAGE = ("msg_", "cnt_", "bec_")
FORENSIC = ("auth_", "url_", "dom_", "bec_")


def psi_of_all(expected: DataFrame, actual: DataFrame, names: list[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """(feature, psi) of every feature in one pass of each side: quantiles of all features in one row, then counts by feature
    and bin, which shrink before the shuffle."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = expected.agg(*[F.percentile(n, at).alias(n) for n in names])
    edges = edges.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("feature", "edges"))  # a row a feature

    def side(df: DataFrame, name: str) -> DataFrame:
        long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("double") for n in names]))).alias("feature", "x"))
        return long.join(F.broadcast(edges), "feature").groupBy("feature", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bin")).agg(F.count(F.lit(1)).alias(name))

    met = side(expected, "e").join(side(actual, "a"), ["feature", "bin"], "full_outer").na.fill(0, ["e", "a"])
    total = met.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    met = met.join(F.broadcast(total), "feature")  # a row a feature
    e, a = (F.greatest(F.coalesce(F.try_divide(F.col(x), F.col(f"t{x}")), F.lit(0.0)), F.lit(eps)) for x in ("e", "a"))
    return met.groupBy("feature").agg(F.round(F.sum((a - e) * F.log(a / e)), 6).alias("psi"))


def subsets(names: list[str], psi: dict[str, float], importance: dict[str, float], stable: float = 0.25) -> dict[str, list[str]]:
    """Seven subsets of features: by drift, by group and the twenty most important; those under three features are left out."""
    low = [n for n in names if psi.get(n, 0.0) < stable]
    out = {
        "all": names, "low_drift": low, "network_header_auth": [n for n in names if n.startswith(NETWORK)], "domain_url_content": [n for n in names if n.startswith(CONTENT)],
        "message_content_bec": [n for n in names if n.startswith(MESSAGE)], "low_drift_forensic": [n for n in low if n.startswith(FORENSIC)],
        "top_20": sorted((n for n in names if n in importance), key=lambda n: (-importance[n], n))[:20],
    }
    return {k: v for k, v in out.items() if len(v) >= 3}


def generalization(train: DataFrame, test: DataFrame, holdout: DataFrame, of: dict[str, list[str]], fit: Fit, y: str = "y") -> DataFrame:
    """A row a subset: measures on test and holdout of a model of the subset, and how far macro F1 falls between them.
    fit(rows, features, y) gives a function that adds `pred`."""
    out = None
    for name, columns in of.items():
        model = fit(train, columns, y)
        row = None
        for prefix, part in (("test_", test), ("holdout_", holdout)):
            m = model(part).agg(*fusion.measures(F.col("pred"), F.col(y), prefix))
            row = m if row is None else row.join(F.broadcast(m))  # one row each
        row = row.select(F.lit(name).alias("subset"), F.lit(len(columns)).alias("features"), "*", F.round(F.col("test_macro_f1") - F.col("holdout_macro_f1"), 4).alias("gap_f1"))
        out = row if out is None else out.unionByName(row)
    return out


def threat(y: Column) -> Column:
    """1 for spam and phishing."""
    return (y > 0).cast("int")


def phishing_or_legitimate(rows: DataFrame, y: str) -> DataFrame:
    """Rows of the two classes, y being 1 for phishing."""
    return rows.filter(F.col(y).isin(0, 2)).withColumn(y, (F.col(y) == 2).cast("int"))


def binary_gaps(views: dict[str, Callable[[DataFrame], DataFrame]], train: DataFrame, test: DataFrame, holdout: DataFrame, names: list[str], fit: Fit, y: str = "y") -> DataFrame:
    """(view, part, tp, fp, tn, fn, recall, specificity, precision, f1, pr_auc, gap_f1, gap_pr_auc) of a binary model a view on
    test and holdout; gaps are test less holdout. fit gives a function that adds `pred` and `score`."""
    out = None
    for name, view in views.items():
        model = fit(view(train), names, y)
        report = lambda part, scored: metrics.binary_report(scored, y, "pred").join(F.broadcast(metrics.pr_auc(scored, y, "score"))).select(F.lit(part).alias("part"), "*")
        both = report("test", model(view(test))).unionByName(report("holdout", model(view(holdout))))
        of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
        gaps = both.agg(*[F.round(of("test", c) - of("holdout", c), 4).alias(f"gap_{c}") for c in ("f1", "pr_auc")])
        row = both.join(F.broadcast(gaps)).select(F.lit(name).alias("view"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def calibrations(fit_on: DataFrame, test: DataFrame, score: str, y: str) -> DataFrame:
    """(method, brier, ece, f1, chosen) on test of a score as it is and calibrated on fit_on by a sigmoid and by isotonic
    regression; chosen is what `ml.pick_calibration` takes."""
    ways = {"uncalibrated": lambda df: df.withColumn("calibrated", F.col(score)), "sigmoid": ml.sigmoid_calibrated(fit_on, score, y)[1], "isotonic": ml.isotonic_calibrated(fit_on, score, y)[1]}
    reports = {}
    for name, way in ways.items():
        c = way(test).select(F.col(y).alias("y"), F.col("calibrated").alias("s"))
        c = c.withColumns({"pred": (F.col("s") >= 0.5).cast("int"), "conf": F.greatest("s", 1 - F.col("s"))}).withColumn("right", F.col("pred") == F.col("y"))
        r = c.agg(F.avg(2 * F.pow(F.col("s") - F.col("y"), 2)).alias("brier")).join(F.broadcast(metrics.binary_report(c, "y", "pred").select("f1"))).join(F.broadcast(metrics.ece(metrics.reliability_bins(c, "conf", "right")).select("ece")))
        reports[name] = {k: float(v if v is not None else 0.0) for k, v in r.first().asDict().items()}  # one row a method
    best = ml.pick_calibration(reports)
    rows = [(k, round(v["brier"], 6), v["ece"], v["f1"], k == best) for k, v in reports.items()]
    return test.sparkSession.createDataFrame(rows, "method string, brier double, ece double, f1 double, chosen boolean")
