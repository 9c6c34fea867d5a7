"""URL filter: rules on hosts and paths, then logistic regression on hashed character n-grams of host and path.

A rule names a host, with all its subdomains, and a prefix of the path; the longest rule that fits decides. For all
other urls the regression does. It is fitted on the driver to a small labelled table of urls, whose size is bounded by a
parameter, and reaches the executors as one vector of weights. The table is made by a rule: words of `url_words` alone and
joined with others, and pronounceable names of random syllables, which stand for hosts that say nothing, as wanted.

Edge cases: a null url, or one without `://`, has an empty host and path; no rule fits it and, having no n-gram, it is
allowed. Repeated rows are judged one by one. Extra columns pass through
`judge`; one with the name of a result gives way to it, and names that begin with `_mp_` are reserved.
An url of any length is hashed whole.
"""

from __future__ import annotations

import itertools
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .url_words import EITHER, UNWANTED, WANTED


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class UrlModel:
    sizes: tuple[int, ...] = (3, 4, 5)  # of n-grams
    buckets: int = 1 << 15
    most_rows: int = 20_000  # of the labelled table
    rounds: int = 400
    rate: float = 2.0
    penalty: float = 1e-4
    threshold: float = 0.6  # probability from which on a url is blocked


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: from there up to ? # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (name, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the last that fits wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def labelled_names() -> list[tuple[str, str, int]]:
    """(name, word it is made of, 1 for unwanted), in a fixed order."""
    draw, out = random.Random(5), []
    for label, words in ((1, UNWANTED.split()), (0, WANTED.split())):
        for word in words:
            out.append((word, word, label))
            for either in draw.sample(EITHER, 8 if label else 4):
                joint = draw.choice(("", "-"))
                out.append((draw.choice((f"{either}{joint}{word}", f"{word}{joint}{either}")), word, label))
    for _ in range(400):
        word = "".join(draw.choice("bcdfghjklmnprstvwz") + draw.choice("aeiou") + draw.choice(["", "", "n", "r", "s", "l"]) for _ in range(draw.randint(2, 4)))
        out.append((word, word, 0))
    return out


def labelled_urls(names: list[tuple[str, str, int]] | None = None) -> list[tuple[str, int]]:
    """The small labelled table (url, 1 for block): each name under two endings, with and without what either kind has."""
    draw, out = random.Random(6), []
    for name, _, label in labelled_names() if names is None else names:
        for _ in range(2):
            host = draw.choice(("", "www.", "m.", "blog.")) + name + draw.choice(("", "", ".example")) + draw.choice((".com", ".net", ".org", ".io"))
            path = draw.choice(("/", "/en/", "/de/", "/es/", "/fr/", "/a/b/", "/index.html")) + draw.choice(("", str(draw.randint(1, 9999))))
            out.append((f"http://{host}{path}", label))
    return out


def grams(host: str, path: str, m: UrlModel) -> list[int]:
    """Slots of the distinct n-grams of host and path, each kind in a space of its own."""
    found = set()
    for kind, text in (("h", f"^{host}$" if host else ""), ("p", f"{path}$" if path else "")):
        for n in m.sizes:
            found.update([kind + text[i : i + n] for i in range(len(text) - n + 1)])
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % m.buckets for g in found]


def split_url(url: str | None) -> tuple[str, str]:
    rest = url.partition("://")[2] if url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, "".join(itertools.takewhile(lambda c: c not in "?#", rest[cut:]))


def fit(rows: list[tuple[str, int]], m: UrlModel = UrlModel()) -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient descent on the mean loss; features are scaled to unit length."""
    rows = rows[: m.most_rows]
    slots = [grams(*split_url(url), m) for url, _ in rows]
    at = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
    col = np.fromiter(itertools.chain.from_iterable(slots), np.int64, len(at))
    value = np.repeat([1 / np.sqrt(max(1, len(s))) for s in slots], [len(s) for s in slots])
    y = np.array([label for _, label in rows], dtype=np.float64)
    w, b = np.zeros(m.buckets), 0.0
    for _ in range(m.rounds):
        z = np.bincount(at, value * w[col], len(rows)) + b
        g = (1 / (1 + np.exp(-z)) - y) / max(1, len(rows))
        w -= m.rate * (np.bincount(col, value * g[at], m.buckets) * len(rows) / 50 + m.penalty * w)
        b -= m.rate * g.sum()
    return w, b


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules: tuple[Rule, ...] = RULES, m: UrlModel = UrlModel()) -> DataFrame:
    """pages with host, path, rule, probability (of block, by the regression) and verdict."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, b = shared.value
        for hosts, paths in batches:
            codes, seen = pd.factorize(pd.MultiIndex.from_arrays([hosts, paths]))
            out = np.zeros(len(seen))
            for i, (host, path) in enumerate(seen):
                slots = grams(host, path, m)
                if slots:
                    out[i] = 1 / (1 + np.exp(-(w[slots].sum() / np.sqrt(len(slots)) + b)))
            yield pd.Series(out[codes])

    host, path = host_and_path(F.col("url"))
    df = pages.select(*pages.columns, host.alias("_mp_host"), path.alias("_mp_path"))
    df = df.withColumn("_mp_rule", rule_of(F.col("_mp_host"), F.col("_mp_path"), rules))
    df = df.withColumn("_mp_p", probability("_mp_host", "_mp_path"))
    by_model = F.when(F.col("_mp_p") >= m.threshold, "block").otherwise("allow")
    results = ("host", "path", "rule", "probability", "verdict")
    return df.select(
        *[c for c in pages.columns if c not in results], F.col("_mp_host").alias("host"), F.col("_mp_path").alias("path"), F.col("_mp_rule.name").alias("rule"),
        F.col("_mp_p").alias("probability"), F.coalesce("_mp_rule.verdict", by_model).alias("verdict"),
    )
