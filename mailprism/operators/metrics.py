"""Model evaluation, calibration and drift as aggregates: one pass over the rows wherever the measure allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import slice_of


def confusion(rows: DataFrame, y: str, pred: str) -> DataFrame:
    return rows.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) from the confusion counts."""
    c = confusion(rows, y, pred)
    tp = c.groupBy(F.col(y).alias("label")).agg(F.sum(F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    said = c.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("said"))
    m = tp.join(said, "label", "left").na.fill(0, ["said"])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return m.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def averages(classes: DataFrame) -> DataFrame:
    """Macro and weighted means of the class measures."""
    n = F.sum("support")
    w = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / n, 6)
    return classes.agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[w(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def argmax(classes: list[str], p: list[Column]) -> Column:
    """Name of the largest; the first on ties."""
    arr = F.array(*p)
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(arr, F.array_max(arr)).cast("int"))


def brier(y: Column, classes: list[str], p: list[Column]) -> Column:
    return F.avg(reduce(lambda a, b: a + b, [F.pow(q - (y == c).cast("double"), F.lit(2)) for c, q in zip(classes, p, strict=True)]))


def log_loss(y: Column, classes: list[str], p: list[Column], floor: float = 1e-12) -> Column:
    own = F.lit(0.0)
    for c, q in zip(classes, p, strict=True):
        own = F.when(y == c, q).otherwise(own)
    return F.avg(-F.log(F.greatest(own, F.lit(floor))))


def reliability_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 10, closed: str = "right") -> DataFrame:
    """(bin, n, mean_confidence, accuracy). closed: `right` takes (lo, hi], `left` takes [lo, hi) and closes the last bin."""
    c = F.col(confidence)
    if closed == "right":
        at = F.greatest(F.ceil(F.round(c * bins, 9)) - 1, F.lit(-1))
    else:
        at = F.least(F.floor(F.round(c * bins, 9)), F.lit(bins - 1))
    rows = rows.withColumn("bin", at.cast("int")).filter("bin >= 0")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def ece(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


def by_score(rows: DataFrame, y: str, score: str) -> DataFrame:
    """(score, pos, neg): rows of equal score are one point of a curve; all curves start from these sums."""
    return rows.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def running(points: DataFrame, columns: list[str], order: Column, slices: int = 256) -> DataFrame:
    """Adds run_<c>: running sums in the order of a number, without gathering all points in one task.

    Points are cut into ranges by sampled quantiles; sums run inside a range and start from the sums of those before it.
    """
    part = slice_of(points, order, slices)
    cut = points.withColumn("_part", part).withColumn("_order", order)
    sums = cut.groupBy("_part").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # at most `slices` rows
    before = sums.select("_part", *[F.coalesce(F.sum(f"s_{c}").over(w), F.lit(0)).alias(f"b_{c}") for c in columns])
    inside = W.partitionBy("_part").orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    out = cut.select("*", *[F.sum(c).over(inside).alias(f"i_{c}") for c in columns]).join(F.broadcast(before), "_part")
    return out.select(*points.columns, *[(F.col(f"i_{c}") + F.col(f"b_{c}")).alias(f"run_{c}") for c in columns])


def roc_auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve: pairs of a positive and a lower negative, ties counting half."""
    run = running(by_score(rows, y, score), ["neg"], F.col("score"))
    wins = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2))
    return run.agg(F.round(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), 6).alias("roc_auc"))


def pr_auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds."""
    run = running(by_score(rows, y, score), ["pos", "neg"], -F.col("score"))
    precision = F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    return run.agg(F.round(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")), 6).alias("pr_auc"))


def threshold_sweep(rows: DataFrame, y: str, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, tn, fn, precision, recall, fpr, f1) in one pass; the thresholds are a short list in the plan."""
    pos, s = F.col(y) == 1, F.col(score)
    wide = []
    for i, t in enumerate(thresholds):
        wide += [F.count_if(pos & (s >= t)).alias(f"tp{i}"), F.count_if(~pos & (s >= t)).alias(f"fp{i}")]
    total = rows.agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"), *wide)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)]))
    m = total.select("p", "q", each.alias("x")).select("x.*", (F.col("q") - F.col("x.fp")).alias("tn"), (F.col("p") - F.col("x.tp")).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.select("threshold", "tp", "fp", "tn", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                    F.round(div(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"), F.round(div(2 * p * r, p + r), 6).alias("f1"))


def recommended_thresholds(sweep: DataFrame, most_fpr: float = 0.005) -> DataFrame:
    """Best F1 (lowest threshold on ties), and the lowest and highest threshold of a small false positive rate."""
    low = F.col("fpr") <= most_fpr
    return sweep.agg(F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t"))).alias("best_f1_threshold"),
                     F.min(F.when(low, F.col("threshold"))).alias("low_fpr_threshold"), F.max(F.when(low, F.col("threshold"))).alias("low_fpr_last"))


def by_source(rows: DataFrame, source: str, y: str, pred: str) -> DataFrame:
    pos, said = F.col(y) == 1, F.col(pred) == 1
    tp, fp, fn = F.count_if(pos & said), F.count_if(~pos & said), F.count_if(pos & ~said)
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(y) == F.col(pred)).cast("double")), 6).alias("accuracy"), F.round(f1, 6).alias("f1"))


def source_summary(per: DataFrame, source: str) -> DataFrame:
    return per.agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"), F.round(F.var_pop("f1"), 6).alias("var_f1"),
                   F.min_by(source, F.struct("f1", source)).alias("hardest"))


def binary_report(rows: DataFrame, y: str, pred: str) -> DataFrame:
    pos, said = F.col(y) == 1, F.col(pred) == 1
    tp, fp, tn, fn = (F.count_if(c) for c in (pos & said, ~pos & said, ~pos & ~said, pos & ~said))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), div(tp, tp + fn).alias("recall"), div(tn, tn + fp).alias("specificity"),
                    div(tp, tp + fp).alias("precision"), div(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def dist_stats(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    c = F.col(column)
    pct = (10, 25, 50, 75, 90, 95, 99)
    out = rows.groupBy(*(by or [])).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                                        F.percentile(c, F.array(*[F.lit(p / 100) for p in pct])).alias("p"))
    return out.select(*(by or []), "n", *[F.round(x, 6).alias(x) for x in ("mean", "std", "min", "max")], *[F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate(pct)])


def histogram(rows: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    """(bin from 1, count); the last bin is closed."""
    c = F.col(column)
    rows = rows.filter(c.between(lo, hi))
    return rows.groupBy(F.least(F.width_bucket(c, F.lit(lo), F.lit(hi), F.lit(n)), F.lit(n)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability by quantile bins of the expected values."""
    c = F.col(column)
    edges = expected.agg(F.percentile(c, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e"))
    side = lambda df, name: df.join(F.broadcast(edges)).groupBy(F.size(F.filter("e", lambda x: x < c)).alias("bin")).agg(F.count(F.lit(1)).alias(name))
    met = side(expected, "e").join(side(actual, "a"), "bin", "full_outer").na.fill(0)
    total = met.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    met = met.join(F.broadcast(total))  # one row
    e, a = F.greatest(F.col("e") / F.col("te"), F.lit(eps)), F.greatest(F.col("a") / F.col("ta"), F.lit(eps))
    return met.agg(F.round(F.sum((a - e) * F.log(a / e)), 6).alias("psi"))


def ecdf_distance(rows: DataFrame, column: str, is_first: Column) -> DataFrame:
    """(ks, wasserstein) of the two samples that is_first tells apart."""
    points = rows.groupBy(F.col(column).cast("double").alias("x")).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    run = running(points, ["a", "b"], F.col("x"))
    total = run.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    gap = F.abs(F.col("run_a") / F.col("ta") - F.col("run_b") / F.col("tb"))
    run = run.join(F.broadcast(total)).select("x", gap.alias("gap"))  # one row
    ordered = run.withColumn("_p", slice_of(run, F.col("x")))
    inner = ordered.withColumn("next", F.lead("x").over(W.partitionBy("_p").orderBy("x")))
    first = ordered.groupBy("_p").agg(F.min("x").alias("first"))
    after = first.withColumn("after", F.lead("first").over(W.orderBy("first"))).select("_p", "after")  # a row a range
    inner = inner.join(F.broadcast(after), "_p").withColumn("width", F.coalesce("next", "after") - F.col("x"))
    return inner.agg(F.round(F.max("gap"), 6).alias("ks"), F.round(F.sum(F.col("gap") * F.coalesce("width", F.lit(0.0))), 6).alias("wasserstein"))


def cohens_d(rows: DataFrame, column: str, is_first: Column) -> DataFrame:
    a, b = F.when(is_first, F.col(column)), F.when(~is_first, F.col(column))
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    return rows.agg(F.round(F.avg(a) - F.avg(b), 6).alias("mean_gap"), F.round(F.try_divide(F.avg(a) - F.avg(b), pooled), 6).alias("cohens_d"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson, and Spearman as Pearson of average ranks; ranks come from counts of distinct values."""
    def ranks(c: str) -> DataFrame:
        run = running(rows.groupBy(F.col(c).cast("double").alias(c)).agg(F.count(F.lit(1)).alias("n")), ["n"], F.col(c))
        return run.select(c, (F.col("run_n") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    both = rows.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).join(ranks(x), x).join(ranks(y), y)
    return both.agg(F.round(F.corr(x, y), 6).alias("pearson"), F.round(F.corr(f"rank_{x}", f"rank_{y}"), 6).alias("spearman"))


def feature_summary(rows: DataFrame, features: list[str], by: list[str], missing: float = -1.0) -> DataFrame:
    """Per feature: share missing and zero, and mean, spread and quartiles of observed values."""
    long = rows.select(*by, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(by, features, "feature", "v")
    v = F.when(F.col("v") != missing, F.col("v"))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*by, "feature").agg(F.avg((F.col("v") == missing).cast("double")).alias("missing_rate"), F.avg((F.col("v") == 0).cast("double")).alias("zero_rate"),
                                           F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"), F.countDistinct(v).alias("unique"))
    return out.select(*by, "feature", *[F.round(x, 6).alias(x) for x in ("missing_rate", "zero_rate", "mean", "std", "min", "max")],
                      *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "median", "q75"))], "unique", (F.col("min") == F.col("max")).alias("zero_variance"))


def drift_level(psi_: Column, ks: Column) -> Column:
    return F.when((psi_ >= 0.25) | (ks >= 0.2), "HIGH").when((psi_ >= 0.1) | (ks >= 0.1), "MODERATE").otherwise("LOW")


def drift_ranked(measured: DataFrame, most: int = 20) -> DataFrame:
    """The features (feature, psi, ks) that drifted most, with their level: a top list."""
    ranked = measured.withColumn("level", drift_level(F.col("psi"), F.col("ks")))
    return ranked.orderBy(F.desc("psi"), F.desc("ks"), "feature").limit(most)


def anova_f(rows: DataFrame, column: str, group: str) -> DataFrame:
    """One-way F from group sums alone."""
    c = F.col(column).cast("double")
    g = rows.groupBy(group).agg(F.count(c).alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("ss"))
    n, s, k = F.sum("n"), F.sum("s"), F.count(F.lit(1))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    within = F.sum("ss") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    return g.agg(F.round(F.try_divide(between / (k - 1), within / (n - k)), 4).alias("f"), k.alias("groups"))


def error_quadrants(rows: DataFrame, y: str, pred: str, confidence: str) -> DataFrame:
    """(y, pred, n, pct of the class, mean confidence)."""
    cell = rows.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"))
    total = cell.groupBy(y).agg(F.sum("n").alias("t"))
    return cell.join(total, y).select(y, pred, "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("pct"), F.round("c", 6).alias("mean_confidence"))


def error_correlates(rows: DataFrame, wrong: Column, flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(wrong.alias("wrong")).agg(F.count(F.lit(1)).alias("n"), *[F.round(100 * F.avg(v.cast("double")), 4).alias(f"pct_{k}") for k, v in flags.items()])


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def flips(before: DataFrame, after: DataFrame, key: str, pred: str, p: str) -> DataFrame:
    """Share of changed predictions and mean shift of a probability, aligned by key."""
    a = before.select(key, F.col(pred).alias("pa"), F.col(p).alias("qa"))
    b = after.select(key, F.col(pred).alias("pb"), F.col(p).alias("qb"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pa") != F.col("pb")).cast("double")), 6).alias("flip_rate"), F.round(F.avg(F.col("qb") - F.col("qa")), 6).alias("mean_shift"))


def class_weights(rows: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    c = rows.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return c.join(F.broadcast(total)).select(y, "n", F.round(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))  # one row


def word_bucket(n: Column) -> Column:
    return F.when(n < 10, "0-9").when(n < 50, "10-49").when(n < 200, "50-199").otherwise("200+")


def champion(candidates: DataFrame, band: float = 0.002) -> DataFrame:
    """Best macro F1; within the band of the best, the best PR-AUC decides, then the name."""
    best = candidates.agg(F.max("macro_f1").alias("top"))
    near = candidates.join(F.broadcast(best)).filter(F.col("macro_f1") >= F.col("top") - band)  # one row
    return near.orderBy(F.desc("pr_auc"), F.desc("macro_f1"), "name").limit(1).select("name", "macro_f1", "pr_auc")
