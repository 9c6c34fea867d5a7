"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word uni- and bigrams are hashed into `buckets`. Two multinomials are counted: one over every document (raw), one over
the trusted documents (target). A document's score is the mean over its n-grams of log(target / raw), so that it does
not depend on length; a document is kept if no base rule fails and its score reaches one threshold, the same for all.
The target and the threshold come from every trusted document: the threshold is `slack` times a low quantile of their
scores. The slack is for documents without label, which score lower, for their own n-grams are not among the target's;
with few trusted rows scores scatter more, and the threshold follows.

With 2 ** 14 buckets the bigrams of a large corpus share them: of 10 million distinct ones some 600 meet in a bucket. A
bucket's ratio is then that of its frequent n-grams; scores stay means over a whole text.

All columns are DataFrame functions; the model enters the scoring plan as a scalar subquery of `buckets` doubles, so
nothing is joined or shuffled with the texts.

Edge cases: a null or wordless text has no n-gram, score 0 and fails the base rule on length. Repeated rows are counted
and judged one by one. A text of any length is judged whole. Extra columns pass through; of `judge`, one with the name of a result gives way to it. Names that
begin with `_mp_` are reserved. Without a trusted document the target is the raw
distribution itself, all ratios are 0 and only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_IDS, WORD_SEPARATORS, drop_settled, settled


@dataclass(frozen=True)
class QualityRules:
    """Production parameters. Each is a feature of the rule, none depends on the size of the corpus."""

    buckets: int = 1 << 14
    prior: float = 4.0  # pseudo-counts a bucket, dealt out as the raw distribution
    quantile: float = 0.001  # of the trusted scores
    slack: float = 2.0  # times that quantile is the threshold, a mean log ratio in nats
    min_words: int = 50
    max_repeat_percent: int = 50


def _tail(a: Column, k: int) -> Column:
    """a without its first k elements."""
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def _head(a: Column, k: int) -> Column:
    """a without its last k elements."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - k, F.lit(0)))


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds _mp_w1 and _mp_w2: 64-bit hashes of a text's words and of its pairs of adjacent words."""
    pieces = F.split(F.coalesce(F.col("text"), F.lit("")), WORD_SEPARATORS)
    df = df.withColumn("_mp_w1", F.transform(F.filter(pieces, lambda w: w != ""), lambda w: F.xxhash64(w)))
    pairs = F.zip_with(_head(F.col("_mp_w1"), 1), _tail(F.col("_mp_w1"), 1), lambda a, b: F.xxhash64(a, b))
    return df.withColumn("_mp_w2", pairs)


def _gram_counts(docs: DataFrame, rules: QualityRules, name: str) -> DataFrame:
    grams = with_hashes(docs).select(F.explode(F.concat("_mp_w1", "_mp_w2")).alias("h"))
    return grams.groupBy(F.pmod("h", F.lit(rules.buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias(name))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all trusted documents: quality 1 and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def _of_trusted(docs: DataFrame, labels: DataFrame, of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """of() over the texts of all trusted documents. Their ids are sent to the executors, BROADCAST_IDS at a time, and the
    table is read once for each such set, so that texts are not shuffled however many there are."""
    ids = settled(trusted_ids(labels), "quality-trusted")
    sets = max(1, -(-ids.count() // BROADCAST_IDS))
    found = []
    for i in range(sets):
        some = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sets)) == i)
        found.append(settled(of(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi")), name))
    drop_settled(ids)
    return reduce(DataFrame.unionByName, found)


def fit(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row, one column `ratio`: the array of log ratios by bucket. Counts cover every document and every trusted one."""
    every = docs.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("b"))
    counts = every.join(_gram_counts(docs.select("text"), rules, "r"), "b", "left")
    trusted = _of_trusted(docs, labels, lambda d: _gram_counts(d, rules, "t"), "quality-target")
    counts = settled(counts.join(trusted.groupBy("b").agg(F.sum("t").alias("t")), "b", "left").na.fill(0), "quality-counts")
    total = counts.agg((F.sum("r") + rules.buckets).alias("rr"), F.sum("t").alias("tt")).first()
    prior = rules.prior * rules.buckets
    raw = (F.col("r") + 1) / F.lit(float(total["rr"]))
    target = (F.col("t") + prior * raw) / F.lit(total["tt"] + prior)
    # one row of `buckets` numbers, whatever the corpus
    pairs = F.array_sort(F.collect_list(F.struct("b", F.log(target / raw).alias("x"))))
    return counts.agg(F.transform(pairs, lambda p: p["x"]).alias("ratio"))


def trusted_scores(docs: DataFrame, ratio: DataFrame, rules: QualityRules) -> DataFrame:
    """x: the scores of docs, null with fewer than min_words. A filter on words would be pushed below the join that picks docs,
    and the texts of all documents cut into words for each set of ids."""
    long_one = F.size("_mp_w1") >= rules.min_words
    scored = with_hashes(docs).withColumn("_mp_ratio", ratio.scalar())
    return scored.select(F.when(long_one, _score(F.col("_mp_ratio"), rules)).alias("x"))


def threshold(docs: DataFrame, labels: DataFrame, ratio: DataFrame, rules: QualityRules = QualityRules()) -> float:
    """The least score that is kept, from the scores of all trusted documents of at least min_words; below 0."""
    found = _of_trusted(docs, labels, lambda d: trusted_scores(d, ratio, rules), "quality-scores").filter("x is not null")
    found = exact_quantile(found, rules.quantile)
    return min(-1e-3, rules.slack * (found or 0.0))


def exact_quantile(values: DataFrame, p: float, width: float = 1e-4) -> float | None:
    """The p-quantile of column x by linear interpolation; None without values. Exact: bins only say where the two ranks
    lie, and the values of those bins are counted; no task or driver holds more than bins or the different values of two."""
    bins = F.floor(F.col("x") / width).alias("bin")
    below, sums = 0, []
    for r in values.groupBy(bins).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect():
        sums.append((r["bin"], below, below + r["n"]))
        below += r["n"]
    if not below:
        return None
    place = p * (below - 1)
    first, last = int(place), min(int(place) + 1, below - 1)
    at = [(b, lo) for b, lo, hi in sums if lo <= last and hi > first]
    among = values.filter(bins.between(at[0][0], at[-1][0])).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x")
    before, found = at[0][1], []
    for r in among.collect():
        found += [r["x"] for k in (first, last) if before <= k < before + r["n"]]
        before += r["n"]
    return found[0] + (found[-1] - found[0]) * (place - first)


def _score(ratio: Column, rules: QualityRules) -> Column:
    grams = F.concat("_mp_w1", "_mp_w2")
    total = F.aggregate(
        grams, F.lit(0.0), lambda acc, h: acc + F.get(ratio, F.pmod(h, F.lit(rules.buckets)).cast("int"))
    )
    return F.when(F.size("_mp_w1") > 0, total / F.size(grams)).otherwise(0.0)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds _mp_repeat: words inside a window of three words that occurs twice or more in the text.

    Windows are compared by 64-bit hash. A first sort on the upper halves, packed with positions into plain longs,
    proposes positions; only those are compared on whole hashes.
    """
    w3 = F.zip_with(_head(F.col("_mp_w2"), 1), _tail(F.col("_mp_w1"), 2), lambda g, w: F.xxhash64(g, w))
    df = df.withColumn("_mp_w3", w3)
    upper = F.lit(-(1 << 32))
    df = df.withColumn(
        "_mp_p", F.sort_array(F.transform("_mp_w3", lambda h, i: h.bitwiseAND(upper).bitwiseOR(i.cast("long"))))
    )
    position = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    both = F.zip_with(
        _head(F.col("_mp_p"), 1),
        _tail(F.col("_mp_p"), 1),
        lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), 32) == 0, F.array(position(a), position(b))),
    )
    df = df.withColumn("_mp_c", F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    exact = F.transform("_mp_c", lambda p: F.struct(F.get("_mp_w3", p).alias("h"), p.alias("p")))
    df = df.withColumn("_mp_e", F.sort_array(exact))
    same = F.zip_with(
        _head(F.col("_mp_e"), 1),
        _tail(F.col("_mp_e"), 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], a["p"] + 1, a["p"] + 2, b["p"], b["p"] + 1, b["p"] + 2)),
    )
    return df.withColumn("_mp_repeat", F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def judge(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    model = settled(fit(docs, labels, rules), "quality-model")
    ratio, least = model.scalar(), threshold(docs, labels, model, rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size_without = lambda chars: F.length(F.translate(text, chars, ""))
    df = _with_repeats(with_hashes(docs)).withColumn("_mp_lines", lines)
    df = df.withColumn("_mp_n", F.size("_mp_w1").cast("long")).withColumn("_mp_repeat", F.col("_mp_repeat").cast("long"))
    failed = (F.col("_mp_n") < rules.min_words) | (
        100 * F.col("_mp_repeat") > rules.max_repeat_percent * F.col("_mp_n")
    )
    # a column first: the analyser takes no subquery inside a higher-order function, the optimiser puts it there
    df = df.withColumn("_mp_failed", failed).withColumn("_mp_ratio", ratio)
    df = df.withColumn("_mp_score", _score(F.col("_mp_ratio"), rules))
    # never false; keeps a later filter from being pushed below, where it would repeat these expressions in one another
    here = F.spark_partition_id() >= 0
    return df.select(
        *[c for c in docs.columns if c not in RESULTS],
        F.col("_mp_n").alias("n_words"),
        size_without(" \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.length(text) - size_without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_mp_lines") - F.size(F.array_distinct("_mp_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_mp_repeat").alias("n_repeat_words"),
        F.col("_mp_failed").alias("base_failed"),
        F.col("_mp_score").alias("score"),
        (~F.col("_mp_failed") & (F.col("_mp_score") >= least) & here).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    judged = judge(docs.withColumn("_mp_row", F.struct(*docs.columns)).select("doc_id", "text", "_mp_row"), labels, rules)
    return judged.filter("kept").select("_mp_row.*")
