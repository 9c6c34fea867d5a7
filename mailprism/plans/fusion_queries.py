"""Queries that compare fusion strategies on stand-ins."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features, fusion, ml, scoring
from .mail_queries import FUSE, P, Q, _fused, _mail
from .registry import query, settled

# The truth of a row is the class that a 3 to 7 mix of both models favours, which neither model nor any weight by quality finds alone.
_TRUE = "(select case when l >= s and l >= h then 0 when s >= h then 1 else 2 end from (select 0.3 * p_legit + 0.7 * q_legit as l, 0.3 * p_spam + 0.7 * q_spam as s, 0.3 * p_phish + 0.7 * q_phish as h))"


def _rows(t):
    f = _fused(t).withColumns({"p": F.array(*P()), "q": F.array(*Q()), "f": F.array("f0", "f1", "f2")})
    return f.withColumn("y", fusion.class_of(F.array(*[0.3 * a + 0.7 * b for a, b in zip(P(), Q())])))


def _arg(*c):
    return f"case when {c[0]} >= {c[1]} and {c[0]} >= {c[2]} then 0 when {c[1]} >= {c[2]} then 1 else 2 end"


@query("case_studies", "WN-17", f"""with {FUSE}, y as (select doc_id, text, {_arg('p_legit', 'p_spam', 'p_phish')} as a, {_arg('q_legit', 'q_spam', 'q_phish')} as b, {_arg('fl', 'fs', 'fp')} as f, {_TRUE} as y from g),
    c as (select *, 'FORENSIC_' || ['LEGIT', 'SPAM', 'PHISH'][a + 1] || '_SEMANTIC_' || ['LEGIT', 'SPAM', 'PHISH'][b + 1] as category from y where a <> b)
    select doc_id, category, ['legitimate', 'spam', 'phishing'][y + 1] as truth, ['legitimate', 'spam', 'phishing'][f + 1] as fused, case when f <> y then 'AMBIGUOUS' when a = y then 'FORENSIC' when b = y then 'SEMANTIC' else 'COMPLEMENTARY' end as diagnosis,
      trim(replace(substr(coalesce(text, ''), 1, 250), chr(10), ' ')) as snippet, (row_number() over (partition by category order by doc_id))::int as rank from c qualify row_number() over (partition by category order by doc_id) <= 2""")
def case_studies(t):
    return fusion.case_studies(_rows(t), "doc_id", "text")


@query("fusion_measures", "AG-61 UD-05 AG-24", f"""with {FUSE}, y as (select *, {_TRUE} as y from g),
    u as (select 'forensic_only' as strategy, y, p_legit a, p_spam b, p_phish c from y union all select 'semantic_only', y, q_legit, q_spam, q_phish from y union all select 'smooth_evidence_weighted', y, fl, fs, fp from y),
    v as (select strategy, y, greatest(a, b, c) as m, {_arg('a', 'b', 'c')} as k from u),
    s as (select strategy, count(*) as n, count(*) filter (where k = y) as ok, avg(m) as m, {', '.join(f"count(*) filter (where k = {c} and y = {c}) as tp{c}, count(*) filter (where k = {c}) + count(*) filter (where y = {c}) as d{c}" for c in range(3))}, count(*) filter (where y = 0) as t0 from v group by 1)
    select strategy, n, round(ok / n, 6) as accuracy, round((coalesce(2 * tp0 / nullif(d0, 0), 0) + coalesce(2 * tp1 / nullif(d1, 0), 0) + coalesce(2 * tp2 / nullif(d2, 0), 0)) / 3, 6) as macro_f1, round(coalesce(2 * tp2 / nullif(d2, 0), 0), 6) as phishing_f1,
      round(coalesce(tp0 / nullif(t0, 0), 0), 6) as legitimate_recall, round(m, 6) as mean_confidence from s""")
def fusion_measures(t):
    return fusion.compared(_rows(t), {"forensic_only": F.col("p"), "semantic_only": F.col("q"), "smooth_evidence_weighted": F.col("f")}, "y")


@query("fusion_learned", "ML-06 AG-61 UD-05")
def fusion_learned(t):
    dims = [F.col("quality")] * len(scoring.QUALITY_WEIGHTS)
    rows = settled(_rows(t).withColumn("meta", scoring.meta_features(P(), Q(), F.col("quality"), dims)).select("doc_id", "y", "p", "q", "quality", "meta"))
    scored = ml.out_of_fold(rows, "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)), 2, lambda r: fusion.learned(r, "meta", "y"))
    p, q = [F.col("p")[i] for i in range(3)], [F.col("q")[i] for i in range(3)]
    six = {k: F.array(*v) for k, v in scoring.strategies(p, q, F.col("quality")).items()} | {"learned": F.col("learned")}
    return fusion.compared(scored, six, "y")


@query("evidence_degradation", "AG-59 CO-10")
def evidence_degradation(t):
    y = F.pmod(F.xxhash64(F.col("msg_body_length"), F.col("url_total_count")), F.lit(3)).cast("int")
    f = features.extract(_mail(t), ["page_id"]).withColumn("y", y)
    f = settled(f.withColumn("q", F.transform(F.array(*map(F.lit, range(3))), lambda i: F.when(i == F.col("y"), 0.5).otherwise(0.25))))
    names = features.names()
    asm = VectorAssembler(inputCols=names, outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol="y", probabilityCol="_p", maxIter=20, regParam=1e-2, family="multinomial").fit(asm.transform(f))
    return fusion.degradation(f, names, lambda df: model.transform(asm.transform(df)).withColumn("p", vector_to_array("_p")))
