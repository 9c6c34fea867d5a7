"""Approximate nearest neighbours by cosine: balanced posting lists around centroids that an in-memory graph finds.

Centroids are fitted to a bounded sample by k-means whose clusters are split while they are too large, so that lists stay
even. A navigable graph over the centroids is searched from fixed entry points by best-first expansion, many vectors at a
time. Every vector goes to its nearest centroid and, if it lies near a boundary, to further ones: those hardly farther
than the nearest, unless a centroid already chosen is nearer to them than the vector is. A query reads the lists whose
centroids are within a ratio of the nearest one's distance, up to a number of them. Ratio and number are not guessed: a
bounded set of vectors is searched by brute force first, and both are set so that this share of their true neighbours is
found. On clustered vectors that is a few lists; vectors without structure need a large share of the table, whatever the
index. Lists carry the vectors in the precision of the table; candidates are scored in double precision; ties go to the
smaller vec_id.

Lists that hold many vectors, such as copies of one, are dealt out in segments, and so are many queries of one list, so
that no task holds an unbounded list. A query that finds fewer than k candidates is answered by a scan of all lists.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part. Rows that repeat a vec_id are one candidate with its best score, and none for themselves. A null vec_id takes no
part. Extra columns are not read. An empty table, or one vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import worker_cache
from .common import settled


@dataclass(frozen=True)
class Index:
    sample: int = 65_536  # vectors that centroids are fitted to, at most
    list_size: int = 100  # vectors a list, aimed at
    most_lists: int = 16_384  # bound of the centroids, which every executor holds; beyond it lists grow with the table
    degree: int = 24  # of the graph
    beam: int = 96  # centroids kept while searching
    replicas: int = 4
    boundary: float = 1.15  # a vector joins lists up to this multiple of its nearest distance
    probes: int = 48  # lists a query reads at most
    pruning: float = 1.35  # and, after the first four, only up to this multiple of its nearest distance
    calibration: int = 128  # vectors searched by brute force, to set the last two
    recall: float = 0.97  # of each of the two on those vectors
    segment: int = 2_048  # vectors, or queries, of a list in a task


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, n: int, p: Index, seed: int = 7) -> np.ndarray:
    """Unit centroids for n vectors: spherical k-means on the sample, clusters over twice their share split in two."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    k = int(np.clip(n // p.list_size, 1, min(p.most_lists, len(x))))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = _nearest(x, c)
        sizes = np.bincount(near, minlength=len(c))
        for j in np.flatnonzero(sizes == 0):  # an empty cluster takes half of the largest
            big = int(sizes.argmax())
            members = np.flatnonzero(near == big)
            far = members[np.argsort(x[members] @ c[big], kind="stable")[: len(members) // 2]]
            near[far] = j
            sizes[[big, j]] = len(members) - len(far), len(far)
        for _ in range(len(c)):  # and so does the emptiest one, while a cluster is over twice its share
            big, small = int(sizes.argmax()), int(sizes.argmin())
            if sizes[big] <= 2 * len(x) / len(c) or sizes[small] * 4 > sizes[big]:
                break
            members = np.flatnonzero(near == big)
            far = members[np.argsort(x[members] @ c[big], kind="stable")[: len(members) // 2]]
            near[far] = small
            sizes = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-300), c)
    return np.unique(c, axis=0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 512] @ c.T).argmax(1) for i in range(0, len(x), 512)])


class Graph:
    """Centroids linked to near ones, diversified, and to a few far ones; searched best first, in batches."""

    def __init__(self, c: np.ndarray, p: Index, seed: int = 11) -> None:
        self.c, self.p = c, p
        k = len(c)
        rng = np.random.default_rng(seed)
        links = np.zeros((k, min(p.degree, max(1, k - 1)) + 2), np.int64)
        for at in range(0, k, 512):
            sims = c[at : at + 512] @ c.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
            near = np.argsort(-sims, axis=1, kind="stable")[:, : links.shape[1] - 2]
            links[at : at + 512, : near.shape[1]] = near if k > 1 else 0
        links[:, -2:] = rng.integers(0, k, (k, 2))
        self.links = links
        self.entries = rng.choice(k, min(k, max(8, int(np.sqrt(k)))), replace=False)

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of the `want` nearest found for each unit vector, nearest first; -1 for none."""
        k, rows = len(self.c), np.arange(len(x))
        beam = min(k, max(want, self.p.beam))
        ids = np.full((len(x), beam), -1, np.int64)
        sims = np.full((len(x), beam), -2.0)
        first = x @ self.c[self.entries].T
        order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
        ids[:, : order.shape[1]] = self.entries[order]
        sims[:, : order.shape[1]] = np.take_along_axis(first, order, 1)
        seen = np.zeros((len(x), k), bool)
        seen[rows[:, None], ids[:, : order.shape[1]]] = True
        expanded = np.zeros((len(x), k), bool)
        for _ in range(4 * beam):
            done = np.where(ids >= 0, np.take_along_axis(expanded, np.maximum(ids, 0), 1), True)
            live = np.flatnonzero(~done[:, : max(want, 16)].all(1))
            if not len(live):
                break
            best = (~done[live]).argmax(1)
            node = ids[live, best]
            expanded[live, node] = True
            to = self.links[node]
            fresh = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            got = np.where(fresh, np.einsum("ijk,ik->ij", self.c[to], x[live]), -2.0)
            all_ids = np.concatenate([ids[live], np.where(fresh, to, -1)], 1)
            all_sims = np.concatenate([sims[live], got], 1)
            # a node linked twice is met twice in one step
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
        return ids[:, :want], sims[:, :want]


def _distance(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * sims))


def lists_of(graph: Graph, x: np.ndarray) -> list[np.ndarray]:
    """The lists that each vector joins."""
    p, out = graph.p, []
    ids, sims = graph.search(x, 3 * p.replicas)
    far = _distance(sims)
    for i in range(len(x)):
        chosen: list[int] = []
        for j, c in enumerate(ids[i]):
            if c < 0 or c in chosen or chosen and far[i, j] > p.boundary * far[i, 0] + 1e-12:
                continue
            if chosen and (_distance(graph.c[chosen] @ graph.c[c]) < far[i, j] * 0.8).any():
                continue
            chosen.append(int(c))
            if len(chosen) == p.replicas:
                break
        out.append(np.array(chosen, np.int64))
    return out


def probes_of(graph: Graph, x: np.ndarray) -> list[np.ndarray]:
    """The lists that each query reads."""
    ids, sims = graph.search(x, graph.p.probes)
    far = _distance(sims)
    near = (far <= graph.p.pruning * far[:, :1] + 1e-12) & (ids >= 0)
    near[:, :4] |= ids[:, :4] >= 0
    return [np.unique(ids[i][near[i]]) for i in range(len(x))]


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as floats if the table has those, else doubles; the length of most."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def calibrated(rows: DataFrame, centroids: np.ndarray, p: Index, k: int) -> Index:
    """p with the probes and the pruning ratio under which the index finds the true neighbours of some vectors.

    Those neighbours come from brute force: a bounded number of queries against all rows, in one pass.
    """
    asked = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(p.calibration).toPandas()
    q, names = _stack(asked["v"]), asked["vec_id"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((q, names))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024]
                scores = _scores(q, _stack(some["v"]))
                scores[names[:, None] == some["vec_id"].to_numpy()] = -2
                near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({
                    "q": np.repeat(np.arange(len(q)), near.shape[1]), "score": np.take_along_axis(scores, near, 1).ravel(),
                    "vec_id": some["vec_id"].to_numpy()[near.ravel()], "v": some["v"].to_numpy()[near.ravel()],
                })

    found = rows.mapInPandas(part, f"q int, score double, vec_id long, v {dict(rows.dtypes)['v']}")
    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("r", best).filter((F.col("r") <= k) & (F.col("score") > -2)).select("q", "v").toPandas()
    if found.empty:
        return p
    graph = Graph(centroids, p)
    far = _distance(_unit(q) @ centroids.T)
    ranks = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
    least = far.min(1)
    needed, ratios = [], []
    for i, lists in zip(found["q"], lists_of(graph, _unit(_stack(found["v"])))):
        needed.append(int(ranks[i, lists].min()) + 1)
        if needed[-1] > 4:
            ratios.append(float(far[i, lists].min() / max(least[i], 1e-9)))
    at = lambda x: float(np.quantile(x, p.recall, method="higher")) if len(x) else 1.0
    return replace(p, probes=max(4, int(at(needed))), pruning=at(ratios))


def _assigned(rows: DataFrame, centroids, key: str, p: Index, how) -> DataFrame:
    """(list, vec_id, v): rows once for each list that `how` gives."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = worker_cache(key, lambda: Graph(centroids.value, p))
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                lists = how(graph, _unit(_stack(some["v"])))
                n = [len(x) for x in lists]
                out = some.loc[some.index.repeat(n)]
                yield pd.DataFrame({"list": np.concatenate(lists), "vec_id": out["vec_id"].array, "v": out["v"].array})

    return rows.mapInPandas(part, f"list long, vec_id long, v {dict(rows.dtypes)['v']}")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines [query, vector], each from its own two vectors alone, so that equal vectors tie exactly."""
    dots = np.einsum("ik,jk->ij", q, x)
    return dots / (np.sqrt(np.einsum("ik,ik->i", q, q))[:, None] * np.sqrt(np.einsum("jk,jk->j", x, x)))


def _best(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(vectors):
        x, ids = _stack(vectors["v"]), vectors["vec_id"].to_numpy()
        for at in range(0, len(queries), 64):
            some = queries.iloc[at : at + 64]
            scores = _scores(_stack(some["v"]), x)
            for i, query in enumerate(some["vec_id"].to_numpy()):
                s = np.where(ids == query, -np.inf, scores[i])
                # all that may be among the k nearest, ties included; a vec_id can occur more than once
                cut = np.partition(s, max(0, len(s) - k))[max(0, len(s) - k)]
                some_ids = np.flatnonzero((s >= cut) & (s > -np.inf))
                seen = set()
                for j in some_ids[np.lexsort((ids[some_ids], -s[some_ids]))]:
                    if ids[j] not in seen:
                        seen.add(ids[j])
                        out.append((int(query), int(ids[j]), float(s[j])))
                        if len(seen) == k:
                            break
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _in_lists(queries: DataFrame, postings: DataFrame, p: Index, k: int) -> DataFrame:
    """The k best of each list segment for each of its queries."""
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    cuts = sizes.join(asked, "list").select(
        "list",
        F.ceil(F.col("n") / p.segment).cast("int").alias("segments"),
        F.ceil(F.col("m") / p.segment).cast("int").alias("chunks"),
    )
    cuts = settled(cuts, "ann-cuts")
    several = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slot = lambda salt, c: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(c)).cast("int")
    x = postings.join(cuts, "list").withColumn("segment", slot(1, "segments")).withColumn("chunk", several("chunks"))
    q = queries.join(cuts, "list").withColumn("chunk", slot(2, "chunks")).withColumn("segment", several("segments"))
    keys = ["list", "segment", "chunk"]
    columns = [*keys, "vec_id", "v"]
    return q.select(columns).groupBy(*keys).cogroup(x.select(columns).groupBy(*keys)).applyInPandas(
        lambda key, a, b: _best(key, a, b, k), FOUND
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best; a vec_id met in several lists counts once. Ranks run over at most k a list segment."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", p: Index = Index()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other vectors for each row where is_query holds."""
    spark = table.sparkSession
    rows = settled(_vectors(table, key, vector), "ann-vectors")
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("v").toPandas()["v"]
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centroids = fit(_stack(chosen), n, p)
    p = calibrated(rows, centroids, p, k)
    shared = spark.sparkContext.broadcast(centroids)
    name = f"{id(shared)}-{len(centroids)}-{float(centroids.sum())!r}"
    postings = settled(_assigned(rows, shared, name, p, lists_of), "ann-postings")
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "v"])
    queries = settled(_assigned(asked, shared, name, p, probes_of), "ann-queries")
    found = settled(_top(_in_lists(queries, postings, p, k), k), "ann-found")
    short = asked.select("vec_id", "v").join(
        found.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= k), "vec_id", "left_anti"
    )
    short = settled(short.select("vec_id", "v"), "ann-short")
    if not short.isEmpty():  # all lists for these; as for the others, in segments
        wide = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(centroids) - 1)))).select(
            F.col("list").cast("long").alias("list"), "vec_id", "v"
        )
        more = _top(_in_lists(wide, postings, p, k), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
