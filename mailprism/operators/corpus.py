"""Corpus preparation: canonical records, rejects, exact and near duplicates, group splits, manifests, data quality."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import net, text

LABELS = ["legitimate", "phishing", "spam", "suspicious", "unknown"]
THREATS = ["clean", "generic_phish", "credential_harvesting", "advance_fee_fraud", "impersonation", "generic_spam", "unknown"]


# ---- records


def joined_addresses(a: Column) -> Column:
    """An array of (name, address) as one string."""
    return F.array_join(F.transform(a, lambda x: x["address"]), ", ")


def accepted(records: DataFrame, body: str = "body") -> DataFrame:
    return records.filter(F.trim(F.coalesce(F.col(body), F.lit(""))) != "")


def rejected(records: DataFrame, body: str = "body") -> DataFrame:
    """What `accepted` leaves out: a null body is rejected too."""
    return records.filter(F.trim(F.coalesce(F.col(body), F.lit(""))) == "")


def mapped_labels(label: Column, phishing: list[str], spam: list[str], threat: str = "generic_phish") -> tuple[Column, Column]:
    """(normalized_label, threat_type) of a source's own labels."""
    norm = F.when(label.isin(phishing), "phishing").when(label.isin(spam), "spam").otherwise("legitimate")
    kind = F.when(norm == "phishing", threat).when(norm == "spam", "generic_spam").otherwise("clean")
    return norm, kind


def invalid_enums(records: DataFrame) -> DataFrame:
    """Rows whose label or threat type is outside the fixed sets."""
    return records.filter(~F.col("normalized_label").isin(LABELS) | ~F.col("threat_type").isin(THREATS))


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def without_holdout(dev: DataFrame, holdout: DataFrame, key: str = "record_id") -> DataFrame:
    return dev.join(holdout.select(key), key, "left_anti")


# ---- duplicates


def exact_duplicates(records: DataFrame, key: str, position: str) -> DataFrame:
    """Adds group_first (first position of the content) and is_first; sums by content are taken before any shuffle of rows."""
    first = records.groupBy(key).agg(F.min(position).alias("group_first"), F.count(F.lit(1)).alias("group_size"))
    return records.join(first, key).withColumn("is_first", F.col(position) == F.col("group_first"))


WORD = re.compile(r"\w+")


def simhash_of(content: str | None, most_tokens: int | None = None) -> int:
    """64-bit SimHash of all tokens and their pairs, as a signed number.

    A feature votes with the root of its count: with the count itself, common words make unrelated long texts alike. With
    most_tokens (80 in the reference) it is that of the first tokens only, and counts vote, as the reference has it.
    """
    tokens = WORD.findall((content or "").lower())[:most_tokens]
    counts = Counter(tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:])])
    if not counts:
        return 0
    features, weights = list(counts), np.fromiter(counts.values(), np.int64)
    if most_tokens is None:
        weights = np.rint(256 * np.sqrt(weights)).astype(np.int64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(features), 65_536):
        digests = b"".join([hashlib.md5(f.encode("utf-8", "surrogatepass")).digest()[:8] for f in features[i : i + 65_536]])
        ones += weights[i : i + 65_536] @ np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * ones > weights.sum()  # + for a set bit, - for another
    return int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def simhash(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in s:
        yield batch.map(simhash_of).astype("int64")


def near_pairs(prints: DataFrame, distance: int = 5, key: str = "id", fp: str = "fp") -> DataFrame:
    """(a, b, hamming) of distinct fingerprints within `distance`: they share one of distance + 1 blocks.

    Rows with equal fingerprints are one node (its smallest key), so that copies are not expanded into pairs.
    """
    nodes = prints.groupBy(fp).agg(F.min(key).alias(key))
    blocks, width = distance + 1, 64 // (distance + 1)
    cut = nodes.select(key, fp, F.posexplode(F.array(*[net.simhash_block(F.col(fp), i, width) for i in range(blocks)])).alias("block", "value"))
    a, b = cut.alias("a"), cut.alias("b")
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    met = met.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), net.hamming(F.col(f"a.{fp}"), F.col(f"b.{fp}")).alias("hamming"))
    return met.filter(F.col("hamming") <= distance).distinct()


def greedy_clusters(nodes: DataFrame, pairs: DataFrame, settle) -> DataFrame:
    """(id, rep): in order of id, a node joins the first earlier representative it is paired with, else becomes one.

    A node is decided once all its earlier neighbours are: each round decides every such node at once, so that rounds
    number the longest chain of undecided neighbours and not the nodes. `settle` cuts lineage.
    """
    undecided = settle(nodes.select("id"))
    decided = nodes.select("id", F.col("id").alias("rep")).limit(0)
    earlier = pairs.select(F.col("b").alias("id"), F.col("a").alias("before"))
    while not undecided.isEmpty():
        known = decided.select(F.col("id").alias("before"), "rep", F.lit(True).alias("known"))
        seen = undecided.join(earlier, "id", "left").join(known, "before", "left")
        state = seen.groupBy("id").agg(
            F.bool_and(F.col("before").isNull() | F.coalesce("known", F.lit(False))).alias("ready"),
            F.min(F.when(F.col("before") == F.col("rep"), F.col("rep"))).alias("rep"),
        )
        state = settle(state)
        now = state.filter("ready").select("id", F.coalesce("rep", "id").alias("rep"))
        decided = settle(decided.unionByName(now))
        undecided = settle(state.filter("not ready").select("id"))
    return decided


def dedup_report(flagged: DataFrame) -> DataFrame:
    """Counters of exact duplicates and the share removed."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_first").alias("retained"),
        F.count_if(~F.col("is_first")).alias("removed"),
        F.round(F.count_if(~F.col("is_first")) / F.count(F.lit(1)), 6).alias("reduction_ratio"),
    )


# ---- splits


def majority_label(records: DataFrame, group: str, label: str, position: str) -> DataFrame:
    """(group, label, size): the most frequent label; ties go to the label seen first."""
    counts = records.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(group).agg(
        F.max_by(label, F.struct("n", (-F.col("first")).alias("f"))).alias("label"), F.sum("n").alias("size")
    )


def group_split(groups: DataFrame, group: str, label: str, seed: int = 42, train: float = 0.75, val: float = 0.15) -> DataFrame:
    """Adds split: within each label, groups in hash order; train and val shares rounded down, one group each at least.

    The hash is MD5 of seed and group, so that any engine can repeat the order.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    by = W.partitionBy(label)
    n = F.count(F.lit(1)).over(by)
    rank = F.row_number().over(by.orderBy(order, group))
    n_train = F.greatest(F.lit(1), F.floor(n * train))
    n_val = F.when(n >= 2, F.greatest(F.lit(1), F.floor(n * val))).otherwise(0)
    split = F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    return groups.withColumn("split", split)


def split_report(records: DataFrame, group: str, label: str) -> DataFrame:
    return records.groupBy("split", label).agg(F.count(F.lit(1)).alias("records"), F.countDistinct(group).alias("groups"))


def leaked_groups(records: DataFrame, group: str) -> DataFrame:
    return records.groupBy(group).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


# ---- data quality


def distribution(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def crosstab(records: DataFrame, row: str, column: str, values: list) -> DataFrame:
    counts = records.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])
    return counts


def missingness(records: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing, pct): null or empty; one pass over all columns."""
    total = F.count(F.lit(1))
    wide = records.agg(total.alias("_n"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    long = wide.unpivot(["_n"], columns, "field", "missing")
    return long.select("field", "missing", F.round(100 * F.col("missing") / F.col("_n"), 4).alias("pct"))


def length_stats(records: DataFrame, by: list[str], column: str) -> DataFrame:
    c = F.col(column)
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("min_len"), F.max(c).alias("max_len"),
        F.round(F.avg(c), 4).alias("mean_len"), F.round(F.median(c), 4).alias("median_len"),
    )


def presence(records: DataFrame, flags: dict[str, Column]) -> DataFrame:
    n = F.count(F.lit(1))
    return records.agg(
        n.alias("total"),
        *[F.count_if(v).alias(f"{k}_count") for k, v in flags.items()],
        *[F.round(100 * F.count_if(v) / n, 4).alias(f"{k}_pct") for k, v in flags.items()],
    )


def rollup_manifest(records: DataFrame, source: str, label: str) -> DataFrame:
    """Counts by source and label, by source, and over all; absent levels are null."""
    return records.rollup(source, label).agg(F.count(F.lit(1)).alias("n"))


def checksum_manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of a binaryFile frame."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    e, f = expected.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("got"), "mismatch").otherwise("ok")
    return e.join(f, "path", "full_outer").select("path", state.alias("state"))


def token_lengths(records: DataFrame, column: str, limits: list[int]) -> DataFrame:
    """Percentiles of word counts and the share of rows over each limit."""
    n = text.blank_words(F.col(column))
    return records.select(n.alias("n")).agg(
        *[F.round(F.percentile("n", p / 100), 4).alias(f"p{p}") for p in (50, 90, 95, 99)],
        *[F.round(F.avg((F.col("n") > k).cast("double")), 6).alias(f"over_{k}") for k in limits],
    )
