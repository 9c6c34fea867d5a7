"""Queries of model evaluation and drift over documents with labels and a deterministic score, and over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from .registry import query

#: A score in steps of 1/200, so that ties occur; and what it predicts.
ROWS = "r as (select doc_id, source, quality as y, toxic, n_chars, ((doc_id * 7919 + quality * 61) % 200) / 200.0::double as s from documents join labels using (doc_id)), q as (select *, (s >= 0.5)::int as pred, abs(s - 0.5) + 0.5 as conf from r)"


def _rows(t):
    d = t("documents").select("doc_id", "source", "n_chars").join(t("labels"), "doc_id")
    d = d.withColumn("y", F.col("quality")).withColumn("s", ((F.col("doc_id") * 7919 + F.col("quality") * 61) % 200) / 200.0)
    return d.withColumn("pred", (F.col("s") >= 0.5).cast("int")).withColumn("conf", F.abs(F.col("s") - 0.5) + 0.5)


@query("confusion", "AG-24", f"with {ROWS} select y, pred, count(*) as n from q group by 1, 2")
def confusion(t):
    return metrics.confusion(_rows(t), "y", "pred")


PRF = f"""{ROWS}, c as (select y as label, count(*) filter (where y = pred) as tp, count(*) as support from q group by 1), d as (select pred as label, count(*) as said from q group by 1),
    m as (select label, tp / said as p, tp / support as r, support from c join d using (label)), k as (select label, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, support from m)"""


@query("prf", "AG-24 ML-09", f"with {PRF} select * from k")
def prf(t):
    return metrics.per_class(_rows(t), "y", "pred")


@query("prf_averages", "AG-24", f"with {PRF} select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(precision * support) / sum(support), 6) as weighted_precision, round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from k")
def prf_averages(t):
    return metrics.averages(metrics.per_class(_rows(t), "y", "pred"))


@query("brier", "AG-25 MA-05", f"with {ROWS} select round(avg(power((1 - s) - (y = 0)::int, 2) + power(s - (y = 1)::int, 2)), 6) as brier from q")
def brier(t):
    return _rows(t).agg(F.round(metrics.brier(F.col("y"), [0, 1], [1 - F.col("s"), F.col("s")]), 6).alias("brier"))


@query("logloss", "AG-26", f"with {ROWS} select round(avg(-ln(greatest(case when y = 1 then s else 1 - s end, 1e-12))), 6) as log_loss from q")
def logloss(t):
    return _rows(t).agg(F.round(metrics.log_loss(F.col("y"), [0, 1], [1 - F.col("s"), F.col("s")]), 6).alias("log_loss"))


def _ece_sql(at: str) -> str:
    return f"with {ROWS}, b as (select {at} as bin, count(*) as n, avg(conf) as c, avg((y = pred)::int) as a from q group by 1) select round(sum(n * abs(a - c)) / sum(n), 6) as ece, round(max(abs(a - c)), 6) as mce from b"


@query("ece_left", "AG-27", _ece_sql("least(floor(round(conf * 10, 9)), 9)"))
def ece_left(t):
    r = _rows(t).withColumn("ok", F.col("y") == F.col("pred"))
    return metrics.ece(metrics.reliability_bins(r, "conf", "ok", 10, "left"))


@query("ece_right", "AG-27", _ece_sql("ceil(round(conf * 10, 9)) - 1"))
def ece_right(t):
    r = _rows(t).withColumn("ok", F.col("y") == F.col("pred"))
    return metrics.ece(metrics.reliability_bins(r, "conf", "ok", 10, "right"))


@query("roc_auc", "AG-28 WN-13", f"with {ROWS}, p as (select s, count(*) filter (where y = 1) as p, count(*) filter (where y <> 1) as n from q group by 1), c as (select p, n, sum(n) over (order by s) as rn from p) select round(sum(p * (rn - n / 2)) / (sum(p)::double * sum(n)), 6) as roc_auc from c")
def roc_auc(t):
    return metrics.roc_auc(_rows(t), "y", "s")


@query("pr_auc", "AG-28 WN-13", f"with {ROWS}, p as (select s, count(*) filter (where y = 1) as p, count(*) filter (where y <> 1) as n from q group by 1), c as (select p, sum(p) over (order by s desc) as rp, sum(n) over (order by s desc) as rn from p) select round(sum(p * rp / (rp + rn)) / sum(p), 6) as pr_auc from c")
def pr_auc(t):
    return metrics.pr_auc(_rows(t), "y", "s")


STEPS = [round(0.05 * i, 2) for i in range(1, 20)]
SWEEP = f"""{ROWS}, t(threshold) as (values {', '.join(f'({x}::double)' for x in STEPS)}), c as (select threshold, count(*) filter (where y = 1 and s >= threshold) as tp, count(*) filter (where y <> 1 and s >= threshold) as fp,
    count(*) filter (where y <> 1 and s < threshold) as tn, count(*) filter (where y = 1 and s < threshold) as fn from q, t group by 1), m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from c),
    w as (select threshold, tp, fp, tn, fn, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from m)"""


@query("threshold_sweep", "AG-29", f"with {SWEEP} select * from w")
def threshold_sweep(t):
    return metrics.threshold_sweep(_rows(t), "y", "s", STEPS)


@query("threshold_recommended", "AG-29 AG-54", f"with {SWEEP} select (select threshold from w order by f1 desc, threshold limit 1) as best_f1_threshold, (select min(threshold) from w where fpr <= 0.2) as low_fpr_threshold, (select max(threshold) from w where fpr <= 0.2) as low_fpr_last")
def threshold_recommended(t):
    return metrics.recommended_thresholds(metrics.threshold_sweep(_rows(t), "y", "s", STEPS), 0.2)


BY_SOURCE = f"{ROWS}, b as (select source, count(*) as n, round(avg((y = pred)::int), 6) as accuracy, round(2 * count(*) filter (where y = 1 and pred = 1) / nullif(2 * count(*) filter (where y = 1 and pred = 1) + count(*) filter (where y <> pred), 0), 6) as f1 from q group by 1)"


@query("by_source", "AG-30 FP-11", f"with {BY_SOURCE} select * from b")
def by_source(t):
    return metrics.by_source(_rows(t), "source", "y", "pred")


@query("by_source_summary", "AG-30", f"with {BY_SOURCE} select round(avg(f1), 6) as mean_f1, min(f1) as min_f1, max(f1) as max_f1, round(var_pop(f1), 6) as var_f1, (select source from b order by f1, source limit 1) as hardest from b")
def by_source_summary(t):
    return metrics.source_summary(metrics.by_source(_rows(t), "source", "y", "pred"), "source")


@query("binary_report", "AG-57 ML-10", f"with {ROWS}, c as (select count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y <> 1 and pred = 1) as fp, count(*) filter (where y <> 1 and pred <> 1) as tn, count(*) filter (where y = 1 and pred <> 1) as fn from q) select *, round(tp / (tp + fn), 6) as recall, round(tn / (tn + fp), 6) as specificity, round(tp / (tp + fp), 6) as precision, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def binary_report(t):
    return metrics.binary_report(_rows(t), "y", "pred")


PCT = ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 6) as p{p}" for p in (10, 25, 50, 75, 90, 95, 99))


@query("dist_stats", "AG-31 AG-34", f"select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_pop(l_extendedprice), 6) as std, round(min(l_extendedprice), 6) as min, round(max(l_extendedprice), 6) as max, {PCT} from lineitem group by 1")
def dist_stats(t):
    return metrics.dist_stats(t("lineitem"), "l_extendedprice", ["l_returnflag"])


@query("histogram", "AG-32", "select least(floor((l_quantity - 1) / (49.0 / 10)) + 1, 10)::bigint as bin, count(*) as count from lineitem where l_quantity between 1 and 50 group by 1")
def histogram(t):
    return metrics.histogram(t("lineitem"), "l_quantity", 1.0, 50.0, 10).withColumn("bin", F.col("bin").cast("long"))


@query("psi", "AG-37 AG-40", """
    with e as (select list(q) as c from (select unnest(quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) as q from lineitem where l_returnflag = 'N')),
    b as (select len(list_filter(c, lambda x: x < l_extendedprice)) as bin, count(*) filter (where l_returnflag = 'N') as e, count(*) filter (where l_returnflag = 'R') as a from lineitem, e where l_returnflag in ('N', 'R') group by 1),
    s as (select sum(e) te, sum(a) ta from b), p as (select greatest(e / te, 1e-4) as e, greatest(a / ta, 1e-4) as a from b, s) select round(sum((a - e) * ln(a / e)), 6) as psi from p""")
def psi(t):
    line = t("lineitem")
    return metrics.psi(line.filter("l_returnflag = 'N'"), line.filter("l_returnflag = 'R'"), "l_extendedprice")


@query("ks_wasserstein", "AG-35 AG-38 WN-14", """
    with p as (select l_quantity as x, count(*) filter (where l_returnflag = 'N') as a, count(*) filter (where l_returnflag = 'R') as b from lineitem where l_returnflag in ('N', 'R') group by 1),
    c as (select x, sum(a) over (order by x) / sum(a) over () as fa, sum(b) over (order by x) / sum(b) over () as fb, lead(x) over (order by x) - x as w from p)
    select round(max(abs(fa - fb)), 6) as ks, round(sum(abs(fa - fb) * coalesce(w, 0)), 6) as wasserstein from c""")
def ks_wasserstein(t):
    return metrics.ecdf_distance(t("lineitem").filter("l_returnflag in ('N', 'R')"), "l_quantity", F.col("l_returnflag") == "N")


@query("cohens_d", "AG-35", """
    with a as (select avg(l_tax) m, var_pop(l_tax) v from lineitem where l_returnflag = 'N'), b as (select avg(l_tax) m, var_pop(l_tax) v from lineitem where l_returnflag = 'R')
    select round(a.m - b.m, 6) as mean_gap, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) as cohens_d from a, b""")
def cohens_d(t):
    return metrics.cohens_d(t("lineitem").filter("l_returnflag in ('N', 'R')"), "l_tax", F.col("l_returnflag") == "N")


@query("correlation", "AG-36", """
    with r as (select l_quantity::double as x, l_discount as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as rx, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2 as ry from lineitem)
    select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r""")
def correlation(t):
    return metrics.correlation(t("lineitem"), "l_quantity", "l_discount")


@query("feature_summary", "AG-10 AG-39 AG-42", """
    with l as (select l_returnflag, 'q' as feature, case when l_linenumber = 7 then -1 else l_quantity end::double as v from lineitem union all select l_returnflag, 'd', l_discount from lineitem), w as (select l_returnflag, feature, v, nullif(v, -1) as o from l)
    select l_returnflag, feature, round(avg((v = -1)::int), 6) as missing_rate, round(avg((v = 0)::int), 6) as zero_rate, round(avg(o), 6) as mean, round(stddev_pop(o), 6) as std, round(min(o), 6) as min, round(max(o), 6) as max,
    round(quantile_cont(o, 0.25), 6) as q25, round(quantile_cont(o, 0.5), 6) as median, round(quantile_cont(o, 0.75), 6) as q75, count(distinct o) as unique, min(o) = max(o) as zero_variance from w group by 1, 2""")
def feature_summary(t):
    rows = t("lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 7, -1.0).otherwise(F.col("l_quantity")).alias("q"), F.col("l_discount").alias("d"))
    return metrics.feature_summary(rows, ["q", "d"], ["l_returnflag"])


@query("anova_f", "AG-41", """
    with g as (select l_shipdate::date - date '1992-01-01' as z, l_linestatus, l_quantity from lineitem), s as (select l_linestatus, count(*) n, sum(l_quantity)::double s, sum(l_quantity * l_quantity)::double ss from g group by 1)
    select round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(ss) - sum(s * s / n)) / (sum(n) - count(*))), 4) as f, count(*) as groups from s""")
def anova_f(t):
    return metrics.anova_f(t("lineitem"), "l_quantity", "l_linestatus")


@query("error_quadrants", "AG-43 AG-44", f"with {ROWS}, c as (select y, pred, count(*) as n, avg(conf) as c from q group by 1, 2), t as (select y, sum(n) as t from c group by 1) select y, pred, n, round(100 * n / t, 4) as pct, round(c, 6) as mean_confidence from c join t using (y)")
def error_quadrants(t):
    return metrics.error_quadrants(_rows(t), "y", "pred", "conf")


@query("error_correlates", "AG-45", f"with {ROWS} select y <> pred as wrong, count(*) as n, round(100 * avg((toxic = 1)::int), 4) as pct_toxic, round(100 * avg((n_chars > 2000)::int), 4) as pct_long from q group by 1")
def error_correlates(t):
    return metrics.error_correlates(_rows(t), F.col("y") != F.col("pred"), {"toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 2000})


@query("error_cases", "WN-10 WN-11", f"with {ROWS} select y, pred, doc_id, rank::int as rank from (select y, pred, doc_id, row_number() over (partition by y, pred order by conf desc, doc_id) as rank from q where y <> pred) where rank <= 5")
def error_cases(t):
    wrong = _rows(t).filter("y <> pred")
    return metrics.top_per_group(wrong, ["y", "pred"], [F.desc("conf"), F.col("doc_id")], 5).select("y", "pred", "doc_id", "rank")


@query("word_buckets", "AG-46", f"with {ROWS} select case when n_chars / 6 < 10 then '0-9' when n_chars / 6 < 50 then '10-49' when n_chars / 6 < 200 then '50-199' else '200+' end as bucket, count(*) as n, round(avg((y = pred)::int), 6) as accuracy from q group by 1")
def word_buckets(t):
    r = _rows(t).withColumn("bucket", metrics.word_bucket(F.col("n_chars") / 6))
    return r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query("flip_rate", "AG-48 JN-14 FP-10", f"with {ROWS} select count(*) as n, round(avg((pred <> (least(s * 1.3, 1.0) >= 0.5)::int)::int), 6) as flip_rate, round(avg(least(s * 1.3, 1.0) - s), 6) as mean_shift from q")
def flip_rate(t):
    r = _rows(t)
    moved = r.withColumn("s", F.least(F.col("s") * 1.3, F.lit(1.0))).withColumn("pred", (F.col("s") >= 0.5).cast("int"))
    return metrics.flips(r, moved, "doc_id", "pred", "s")


@query("class_weights", "AG-56", f"with {ROWS}, c as (select y, count(*) as n from q group by 1) select y, n, round((select sum(n) from c) / ((select count(*) from c) * n), 6) as weight from c")
def class_weights(t):
    return metrics.class_weights(_rows(t), "y")


@query("champion", "AG-58", "select 'b' as name, 0.8995::double as macro_f1, 0.96::double as pr_auc")
def champion(t):
    one = t("region").limit(1)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("macro_f1"), F.lit(p).alias("pr_auc")) for n, f, p in (("a", 0.9, 0.95), ("b", 0.8995, 0.96), ("c", 0.89, 0.99))])).alias("x"))
    return metrics.champion(rows.select("x.*"))


@query("severity_crosstab", "AG-33", f"with {ROWS}, v as (select quality_ as y, case when s >= 0.75 then 'CRITICAL' when s >= 0.5 then 'HIGH' when s >= 0.25 then 'MEDIUM' else 'LOW' end as severity from (select *, y as quality_ from q)) select severity, count(*) filter (where y = 0) as y_0, count(*) filter (where y = 1) as y_1 from v group by 1")
def severity_crosstab(t):
    sev = F.when(F.col("s") >= 0.75, "CRITICAL").when(F.col("s") >= 0.5, "HIGH").when(F.col("s") >= 0.25, "MEDIUM").otherwise("LOW")
    return _rows(t).withColumn("severity", sev).groupBy("severity").agg(F.count_if(F.col("y") == 0).alias("y_0"), F.count_if(F.col("y") == 1).alias("y_1"))
