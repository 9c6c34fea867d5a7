"""Mixing sources to target weights by entropy balancing.

Sources have weights; the mix holds `percent` of all words. A source's target is its share of the mix, at most `most`
times its own size; what exceeds that is reshared by weight until no target is above. Among all rates that meet the
targets, those nearest to one copy of each document in relative entropy are exponential tilts,

    rate = min(most, exp(lambda_source * g)),    g = (size + mean / 2) / (size + mean),

g being a document's balancing covariate, between 1/2 and 1, with the mean size of its source. The tilts minimise a
convex dual, sum(size / g * psi(lambda * g)) - lambda * target with psi' = min(most, exp), by Newton's method: an
iteration is one distributed aggregate, and all sources step at once. It works on a histogram (source, size, documents),
which is exact as rates depend on nothing else.

Rates become copies: the whole part, plus one if a hash of the row, less the fraction, is under the source's threshold.
The hash covers doc_id, source, the text and, for rows that agree in these, their number among them.
A threshold of 0 rounds without bias; it is moved to the point where the words taken come nearest to the target, which
two histograms of that difference find to within a document.

Edge cases: a null text has size 0, and documents of size 0 have no copies. Null sources are one source, the last. Rows
that repeat a doc_id, null or not, are rounded one by one, so that their source comes near its target too; which of
several equal rows is taken once more is open. A text of any length is counted whole. Extra columns pass through `mixed`, except names that begin with `_mp_`.
An empty table, or one without a word, takes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, numbered_repeats, settled


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # of the sources in code point order, repeating
    percent: int = 150
    most: int = 2  # copies of a document, and targets in sizes of their source
    rounds: int = 40  # Newton iterations at most; a handful are needed
    tolerance: float = 1e-9  # of a source's size


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the source as (_mp_s, _mp_null), which joins nulls too, and a hash of these and the text."""
    source = F.col("source").cast("string")
    rows = docs.select("doc_id", source.alias("source"), *_row_columns())
    return numbered_repeats(rows, "_mp_h", "_mp_n")


def _row_columns() -> list[Column]:
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    h = F.xxhash64("doc_id", F.col("doc_id").isNull(), source, source.isNull(), "text")
    return [n.alias("size"), F.coalesce(source, F.lit("")).alias("_mp_s"), source.isNull().alias("_mp_null"), h.alias("_mp_h")]


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds the position of each source in code point order, null last, counted by ranges and not in one task."""
    n = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    parts = sources.repartitionByRange(n, "_mp_null", "_mp_s").withColumn("_mp_part", F.spark_partition_id())
    parts = settled(parts, "sources")
    before = parts.groupBy("_mp_part").count().withColumn(
        "_mp_before", F.coalesce(F.sum("count").over(W.orderBy("_mp_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )  # a row for each partition
    inside = F.row_number().over(W.partitionBy("_mp_part").orderBy("_mp_null", "_mp_s"))
    return parts.withColumn("_mp_in", inside).join(before, "_mp_part").withColumn(
        "position", F.col("_mp_before") + F.col("_mp_in") - 1
    ).drop("_mp_part", "_mp_before", "_mp_in", "count")


def targets(histogram: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row for each source: _mp_s, _mp_null, source_size, mean, target."""
    sources = histogram.groupBy("_mp_s", "_mp_null").agg(
        F.sum(F.col("size") * F.col("docs")).alias("source_size"),
        (F.sum(F.col("size") * F.col("docs")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("docs"))), F.lit(1))).alias("mean"),
    )
    sources = _numbered(sources)
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("position") % len(mix.weights) + 1).cast("int"))
    sources = settled(sources.withColumn("weight", weight).withColumn("cap", F.lit(float(mix.most)) * F.col("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full: Column = F.lit(False)
    level = 0.0
    budget = total * mix.percent / 100
    n_full = -1
    while True:  # each round at least one more source is full
        now = sources.withColumn("full", full).agg(
            F.sum(F.when(~F.col("full"), F.col("weight"))).alias("free"),
            F.sum(F.when(F.col("full"), F.col("cap"))).alias("held"),
            F.count_if("full").alias("n"),
        ).first()
        if now["n"] == n_full or not now["free"]:
            break
        n_full = now["n"]
        level = (budget - (now["held"] or 0.0)) / now["free"]
        full = F.col("weight") * level >= F.col("cap")
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * level)
    return sources.withColumn("target", target.cast("double")).drop("weight", "cap")


def _covariate() -> Column:
    """Of documents with words; sizes of 0 take no part."""
    return (F.col("size") + F.col("mean") / 2) / F.greatest(F.col("size") + F.col("mean"), F.lit(1.0))


def _rate(mix: Mix) -> Column:
    """exp before the cap would overflow for no argument that Newton's steps visit, as they are clipped."""
    return F.when(F.col("size") > 0, F.least(F.lit(float(mix.most)), F.exp(F.col("lambda") * _covariate()))).otherwise(0.0)


def solve(histogram: DataFrame, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sources with lambda: Newton's method on the dual, safeguarded by bisection between known bounds."""
    low, high = -60.0, 2.0  # at 2 * ln(most) <= 2 every rate is capped
    state = sources.withColumns({"lambda": F.lit(0.0), "lo": F.lit(low), "hi": F.lit(high)})
    words, g = F.col("size") * F.col("docs"), _covariate()
    for _ in range(mix.rounds):
        state = settled(state, "tilts")
        met = histogram.join(state, ["_mp_s", "_mp_null"]).withColumn("r", _rate(mix))
        step = met.groupBy("_mp_s", "_mp_null").agg(
            F.sum(words * F.col("r")).alias("taken"),
            F.sum(F.when(F.col("r") < mix.most, words * g * F.col("r"))).alias("slope"),
        )
        state = state.join(step, ["_mp_s", "_mp_null"])
        gap = F.col("taken") - F.col("target")
        done = F.abs(gap) <= mix.tolerance * F.greatest(F.col("source_size"), F.lit(1))
        state = settled(state.withColumn("done", done).withColumn("gap", gap), "tilts")
        if state.filter("not done").isEmpty():
            break
        lo = F.when(F.col("gap") < 0, F.col("lambda")).otherwise(F.col("lo"))
        hi = F.when(F.col("gap") > 0, F.col("lambda")).otherwise(F.col("hi"))
        newton = F.col("lambda") - F.try_divide("gap", "slope")
        inside = newton.isNotNull() & (newton > lo) & (newton < hi)
        moved = F.when(F.col("done"), F.col("lambda")).when(inside, newton).otherwise((lo + hi) / 2)
        state = state.select(
            *sources.columns, moved.alias("lambda"), lo.alias("lo"), hi.alias("hi")
        )
    return state.select(*sources.columns, "lambda")


def _critical() -> Column:
    """The threshold from which on a document has one copy more than the whole part of its rate."""
    u = F.shiftrightunsigned(F.xxhash64("_mp_h", "_mp_n"), 11) / F.lit(float(1 << 53))
    return u - (F.col("rate") - F.floor("rate"))


def _thresholds(docs: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """sources with threshold: where the words taken come nearest to the target."""
    key = ["_mp_s", "_mp_null"]
    slots = 1 << 12
    met = docs.join(sources, key).withColumn("rate", _rate(mix))
    free = met.filter(F.floor("rate") < mix.most).withColumn("c", _critical())
    base = met.groupBy(*key).agg(F.sum(F.col("size") * F.floor("rate")).alias("base"))
    out = sources.join(base, key, "left").withColumns(
        {"need": F.col("target") - F.coalesce("base", F.lit(0)), "lo": F.lit(-1.0), "width": F.lit(2.0)}
    )
    out = settled(out, "thresholds")
    for _ in range(3):  # 36 bits of the difference
        met = free.select(*key, "size", "c").join(out.select(*key, "lo", "width"), key)
        slot = F.floor((F.col("c") - F.col("lo")) / F.col("width") * slots)
        sums = met.filter((slot >= 0) & (slot < slots)).groupBy(*key, slot.alias("slot")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("run", F.sum("words").over(W.partitionBy(*key).orderBy("slot")))
        # the slots wholly under the threshold are those whose running sum stays within the need
        under = run.join(out.select(*key, "need"), key).filter("run <= need").groupBy(*key).agg(
            F.max("slot").alias("slot"), F.max("run").alias("run")
        )
        first = run.join(out.select(*key, "need"), key).filter("run > need").groupBy(*key).agg(F.min("slot").alias("next"))
        out = out.join(under, key, "left").join(first, key, "left")
        at = F.coalesce("next", F.coalesce(F.col("slot"), F.lit(-1)) + 1)
        out = out.withColumns({
            "lo": F.col("lo") + at / F.lit(float(slots)) * F.col("width"),
            "width": F.col("width") / slots,
            "need": F.col("need") - F.coalesce("run", F.lit(0)),
        }).drop("slot", "run", "next")
        out = settled(out, "thresholds")
    # one slot is left: take it if that comes nearer
    met = free.select(*key, "size", "c").join(out.select(*key, "lo", "width"), key)
    last = met.filter((F.col("c") >= F.col("lo")) & (F.col("c") < F.col("lo") + F.col("width"))).groupBy(*key).agg(F.sum("size").alias("words"))
    out = out.join(last, key, "left")
    nearer = F.coalesce("words", F.lit(0)) / 2 <= F.col("need")
    threshold = F.when(nearer, F.col("lo") + F.col("width")).otherwise(F.col("lo"))
    return settled(out.select(*sources.columns, threshold.alias("threshold")), "thresholds")


def _copies(mix: Mix) -> Column:
    whole = F.floor("rate").cast("long")
    more = (whole < mix.most) & (F.col("size") > 0) & (_critical() < F.col("threshold"))
    return F.when(F.col("size") > 0, whole + more.cast("long")).otherwise(F.lit(0).cast("long"))


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(narrow documents, sources): doc_id, source and size of every row; all that decides the copies of a source."""
    narrow = settled(sizes(docs), "mix-docs")
    histogram = settled(narrow.groupBy("_mp_s", "_mp_null", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-sizes")
    tilted = settled(solve(histogram, targets(histogram, mix), mix), "tilts")
    return narrow, _thresholds(narrow, tilted, mix)


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row of docs."""
    narrow, sources = plan(docs, mix)
    met = narrow.join(sources.drop("position"), ["_mp_s", "_mp_null"]).withColumn("rate", _rate(mix))
    met = met.withColumn("copies", _copies(mix))
    return met.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it. Texts are not shuffled: sources are joined to them."""
    _, sources = plan(docs, mix)
    wide = docs.select(F.struct(*docs.columns).alias("_mp_row"), "doc_id", "source", "text")
    wide = wide.select("_mp_row", *_row_columns())
    wide = numbered_repeats(wide, "_mp_h", "_mp_n")
    met = wide.join(sources, ["_mp_s", "_mp_null"]).withColumn("rate", _rate(mix)).withColumn("copies", _copies(mix))
    repeated = met.withColumn("_mp_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_mp_row.*")
