"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set holds its distinct five-word shingles (64-bit hashes). Sets are ordered by one global order: rare
shingles first by a count sketch over every document, then by hash. If two sets of n and m shingles must share t, then
among the first n - t + k of the one and the first m - t + k of the other they share k at least. Each document chooses
its own k: a longer prefix costs more postings but lets fewer candidates through, and the k with the least estimated
cost wins. Two documents are candidates if they share min(k, k') shingles at such positions; candidates are verified
on their whole sets.

The sketch only steers cost. Whatever it says, every link is found: nothing is sampled, capped or dropped.

Large groups of near copies are not expanded into all pairs. Equal sets are one class to begin with. A first round
verifies each class against hubs only: in each posting list, the member whose shared shingle stands earliest, that is
the one with the fewest shingles of its own. While the lists that are still open would cost too much, their members
outside the largest component are held against a few others of it that a hash picks. A last round takes all candidate
pairs whose members are not yet connected; pairs inside a component cannot change it. Components are found by joins that contract the graph.

Edge cases: a null, empty or wordless text has an empty set and is linked with nothing; fewer than five words are one
shingle. A text is shingled whole, however long; a worker holds the shingles of 2 MB of texts, or of one longer text, at
once. Rows that repeat a doc_id are one document; if their texts differ, the smallest text counts. Rows without doc_id are returned with a null component and are compared with nothing. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import few_mb, hashed_words, release
from .common import by_ids, compact, drop_settled, held, settled, small_batches


@dataclass(frozen=True)
class JaccardJoin:
    words: int = 5  # of a shingle
    percent: int = 75  # least similarity
    sketch_slots: int = 32  # counters a document, of two bytes, in the sketch of the shingles
    most_bits: int = 25  # the sketch has 2 ** 25 counters at most
    most_matches: int = 12  # largest k
    verify_cost: float = 40.0  # of a candidate, in postings read
    hot: int = 2_000  # estimated documents from which on a shingle's list is dealt to several tasks
    block: int = 4_096  # members of an open list that one task sets others against
    picks: int = 4  # members of a component that a stranger is held against in a turn
    open_cost: float = 64.0  # of the open lists, in postings, up to which no more turns are taken

    def overlap(self, n, m):
        """Least intersection of linked sets of n and m elements: ceil(p (n + m) / (100 + p))."""
        whole = 100 + self.percent
        return (self.percent * (n + m) + whole - 1) // whole


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTORS[3]
    x = (x ^ (x >> np.uint64(29))) * _FACTORS[0]
    return x ^ (x >> np.uint64(32))


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive hashes."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out * _FACTORS[1] + h[i : n + i])
    return out


def shingles(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each whole text; A-Z count as a-z."""
    h, bounds = hashed_words(texts)
    every, out = _windows(h, words), []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = last - first
        x = np.sort(every[first : last - words + 1] if n >= words else _windows(h[first:last], n) if n else h[:0])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if n > words else x)
    return out


#: Bytes of text whose shingles a worker holds at once; a longer text is held alone.
TEXT_RUN = 2 << 20


def _first_pass(docs: DataFrame, bits: int, p: JaccardJoin) -> DataFrame:
    """A row for each document (doc_id, n, fp) and, from each task, the counters of its shingles in 64 blobs."""
    size, schema = 1 << bits, "doc_id long, n long, fp binary, part int, counts binary"
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(size, np.uint16)
        for whole in batches:
            for batch in few_mb(whole, TEXT_RUN):
                sets = shingles(batch.column("text"), p.words)
                slots, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                counts[slots] = np.minimum(counts[slots] + n, 65_535)  # a counter stays at its top
                none = [None] * len(sets)
                fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(fp, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=kinds)
        for i, part in enumerate(np.split(counts, 64)):
            if part.any():
                yield pa.record_batch([pa.array([x], kind) for x, kind in zip([None, None, None, i, zlib.compress(part.tobytes(), 1)], kinds.types, strict=True)], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def _sketch(first: DataFrame, bits: int) -> np.ndarray:
    """The counters of all documents, each a level: 4 log2 of what it holds over the usual. Bounded by most_bits."""

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in parts:
            for x in batch["counts"]:
                got = np.frombuffer(zlib.decompress(x), np.uint16).astype(np.uint32)
                total = got if total is None else total + got
        usual = float(np.median(total))
        levels = np.round(4 * np.log2(1 + np.maximum(0, total - 3 * usual - 3))).astype(np.uint8)
        yield pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(levels.tobytes(), 1)]})

    blobs = first.filter("part is not null").select("part", "counts")
    summed = blobs.groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    levels = np.zeros((64, (1 << bits) // 64), np.uint8)
    for row in summed:
        levels[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return levels.ravel()


def _postings(docs: DataFrame, levels: np.ndarray, p: JaccardJoin) -> DataFrame:
    """(token, id, at, nk, hot): the prefix of each document's set at its chosen k; nk packs n and k.

    hot: the sketch has counted the token's slot often, so that its list may be too long for one task.
    """
    shift = 65 - len(levels).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    hot = round(4 * np.log2(p.hot))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        levels = shared.value
        k = np.arange(1, p.most_matches + 1)
        for whole in batches:
            for batch in few_mb(whole, TEXT_RUN):
                tokens, sizes, packed, common = [], [], [], []
                for s in shingles(batch.column("text"), p.words):
                    n = len(s)
                    if not n:
                        sizes.append(0)
                        packed.append(0)
                        continue
                    level = levels[s >> np.uint64(shift)]
                    order = np.argsort(level, kind="stable")  # hashes are in order already
                    least = -(-p.percent * n // 100)
                    most = min(p.most_matches, least)
                    length = n - least + k[:most]
                    cost = np.cumsum(np.exp2(level[order[: length[-1]]] / 4.0))[length - 1] + length
                    chosen = int(np.argmin(cost * (1 + p.verify_cost / k[:most] ** 2)))
                    prefix = order[: length[chosen]]
                    tokens.append(s[prefix])
                    common.append(level[prefix] >= hot)
                    sizes.append(len(prefix))
                    packed.append(n << 8 | chosen + 1)
                if tokens:
                    ids = np.repeat(np.arange(len(sizes)), sizes)
                    at = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), batch.column("doc_id").take(pa.array(ids)),
                         pa.array(at), pa.array(np.array(packed, np.int64)[ids]), pa.array(np.concatenate(common))],
                        ["token", "id", "at", "nk", "hot"],
                    )

    return docs.select("doc_id", "text").mapInArrow(rows, "token long, id long, at int, nk long, hot boolean")


def _unpacked(nak: str) -> dict[str, Column]:
    c = F.col(nak)
    return {
        "at": F.shiftright(c, 36).cast("int"),
        "n": F.shiftright(c, 8).bitwiseAND(F.lit((1 << 28) - 1)).cast("int"),
        "k": c.bitwiseAND(F.lit(255)).cast("int"),
    }


def _shared(postings: DataFrame, p: JaccardJoin) -> DataFrame:
    """Postings that may have a partner, with the hub of their list: token, id, at, n, k, h (a struct of the last four).

    Lists of common tokens are summed before they are shuffled and joined with room for a split of long ones; all others
    are shuffled once, for both the sums and the join.
    """

    def with_hub(rows: DataFrame) -> DataFrame:
        n = F.shiftright("nak", 8).bitwiseAND(F.lit((1 << 28) - 1))
        lists = rows.groupBy("token").agg(
            F.count(F.lit(1)).alias("c"), F.min(n).alias("least"), F.min(F.struct("nak", "id")).alias("hub")
        )
        met = rows.join(lists.filter("c > 1"), "token").withColumns(_unpacked("nak"))
        # a posting whose position leaves too little even for the smallest set of its list has no partner there
        most = F.floor((F.col("n") - F.col("at") + F.col("k") - 1) * (100 + p.percent) / p.percent) - F.col("n")
        met = met.filter(most >= F.col("least")).withColumn("hak", F.col("hub.nak"))
        hub = F.struct(F.col("hub.id").alias("id"), *[v.alias(c) for c, v in _unpacked("hak").items()])
        return met.select("token", "id", "at", "n", "k", hub.alias("h"))

    nak = F.shiftleft(F.col("at").cast("long"), 36).bitwiseOR(F.col("nk"))  # one long to shuffle
    narrow = ["token", "id", nak.alias("nak")]
    rare = postings.filter("not hot").select(narrow)
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_hub(rare.repartition(n, "token")).unionByName(with_hub(postings.filter("hot").select(narrow)))


def _fits(p: JaccardJoin, n: Column, at: Column, k: Column, m: Column, at2: Column, k2: Column) -> Column:
    """Whether a shared shingle at positions at, at2 counts towards the min(k, k2) that a link must show."""
    t = F.floor((p.percent * (n + m) + 99 + p.percent) / (100 + p.percent))
    least = F.least(k, k2)
    return (at < n - t + least) & (at2 < m - t + least)


def _open_lists(shared: DataFrame, near: DataFrame, p: JaccardJoin) -> tuple[DataFrame, int]:
    """One-match postings of lists whose members are in several components, with the list's largest one, `top`; the cost.

    The cost is that of setting all strangers of a list, its members outside top, against the whole list.
    """
    # a pair that shares k shingles in the prefixes for k shares one in those for one: lists need no more
    first = F.col("at") <= F.col("n") - F.ceil(p.percent * F.col("n") / 100)
    rooted = shared.filter(first).select("token", "id", "n", "at").join(near, "id", "left")
    rooted = held(rooted.withColumn("root", F.coalesce("root", "id")))
    lists = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    lists = lists.groupBy("token").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots"))
    lists = lists.filter("roots > 1").select("token", "c", F.col("top.root").alias("top"))
    met = compact(rooted.join(lists, "token"), "jaccard-open")
    rooted.unpersist()
    return met, met.filter("root <> top").agg(F.sum("c")).first()[0] or 0


def _probes(met: DataFrame, turn: int, p: JaccardJoin) -> DataFrame:
    """A few pairs (a, b) for each stranger: with members of top that a hash picks in its lists, those met most often."""
    member, one = F.struct("id", "n", "at"), F.lit(1)
    picked = [F.min_by(member, F.xxhash64("id", F.lit(turn * p.picks + i))) for i in range(p.picks)]
    picked = met.filter("root = top").groupBy("token").agg(F.array_distinct(F.array(*picked)).alias("y"))
    both = met.filter("root <> top").join(picked.select("token", F.explode("y").alias("y")), "token")
    y = F.col("y")
    both = both.filter(_fits(p, F.col("n"), F.col("at"), one, y["n"], y["at"], one))
    found = both.groupBy("id", y["id"].alias("b")).agg(F.count(F.lit(1)).alias("matches"))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("matches"), "b"))  # of a few for each list of one id
    return found.withColumn("r", best).filter(F.col("r") <= p.picks).select(F.col("id").alias("a"), "b")


def _multi_match(pairs: DataFrame, postings: DataFrame, p: JaccardJoin) -> DataFrame:
    """The pairs (a, b) that share min(k, k') shingles in their prefixes for that number."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    prefix = F.array_sort(F.collect_list(F.struct("at", "token"))).alias("prefix")  # a part of one document's set
    of = postings.join(ids, "id", "left_semi").groupBy("id", "n", "k").agg(prefix)
    of = held(of)
    named = lambda c: of.select(*[F.col(x).alias(x + c) for x in ("id", "n", "k", "prefix")])
    both = pairs.join(named("a"), F.col("a") == F.col("ida")).join(named("b"), F.col("b") == F.col("idb"))
    least = F.least("ka", "kb")
    t = F.floor((p.percent * (F.col("na") + F.col("nb")) + 99 + p.percent) / (100 + p.percent))
    within = lambda c: F.transform(
        F.filter("prefix" + c, lambda x: x["at"] < F.col("n" + c) - t + least), lambda x: x["token"]
    )
    found = both.filter(F.size(F.array_intersect(within("a"), within("b"))) >= least).select("a", "b")
    found = compact(found, "jaccard-pairs")
    of.unpersist()
    return found


def _open_pairs(met: DataFrame, shared: DataFrame, known: DataFrame, p: JaccardJoin) -> DataFrame:
    """The pairs (a, b) of documents in different components that share min(k, k') shingles for that number, less those known.

    Pairs are listed by the shortest prefixes, which by their positions let the fewest meet, and must then show all their
    matches. Only strangers are set against others, so that a list that belongs to one large component costs its strangers
    times its length. Members meet within sizes that allow a link, and long lists in blocks, each a task's work.
    """
    # sizes of one bucket differ by a little more than linked ones may, so that links join a bucket or two adjacent ones
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.001 / p.percent))).cast("int")
    met = met.withColumn("bucket", bucket).withColumn("blocks", F.ceil(F.col("c") / p.block).cast("int"))
    x = met.filter("root <> top").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("y")
    n, m, one = F.col("x.n"), F.col("y.n"), F.lit(1)
    both = x.join(y, [
        *[F.col("x." + k) == F.col("y." + k) for k in ("token", "bucket", "block")], F.col("x.root") != F.col("y.root"),
        (F.col("y.root") == F.col("y.top")) | (F.col("x.id") < F.col("y.id")), _fits(p, n, F.col("x.at"), one, m, F.col("y.at"), one),
    ])
    pairs = both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    pairs = compact(pairs.join(known, ["a", "b"], "left_anti"), "jaccard-met")
    found = _multi_match(pairs, shared, p)
    drop_settled(pairs)
    return found


def _joined(near: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, root) of near and further links (a, b)."""
    of = lambda c: near.withColumnsRenamed({"id": c, "root": f"r{c}"})
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    met = met.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    last = components(met)
    known = near.unionByName(last.join(near, "id", "left_anti").select("id", F.col("id").alias("root")))
    known = known.join(last.select(F.col("id").alias("root"), F.col("root").alias("end")), "root", "left")
    return compact(known.select("id", F.coalesce("end", "root").alias("root")), "jaccard-roots")


def _sets(docs: DataFrame, ids: DataFrame, p: JaccardJoin) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in few_mb(whole, TEXT_RUN):
                sets = shingles(batch.column("text"), p.words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "s"])

    return by_ids(docs, ids, "doc_id", "left_semi").mapInArrow(rows, "id long, s array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    with small_batches(docs.sparkSession):
        sets = held(_sets(docs.select("doc_id", "text"), ids, p))
    left = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))  # the sets hold distinct hashes
    both = both.withColumn("common", common).withColumn("union", F.size("sa") + F.size("sb") - F.col("common"))
    links = compact(both.filter(100 * F.col("common") >= p.percent * F.col("union")).select("a", "b"), "jaccard-links")
    sets.unpersist()
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): root is the smallest id that links reach.

    Each round points every vertex to its smallest neighbour if that is smaller, follows the pointers to their ends and
    joins vertices with the same end into one; edges between two of those make the next round. A component's vertices
    other than its root at least halve in a round.
    """
    edges = compact(edges.filter("a <> b").select("a", "b"), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root"))
        to = compact(to.withColumn("moved", F.lit(True)), "pointers")
        while True:
            ends = to.select(F.col("id").alias("root"), F.col("root").alias("end"))
            far = to.select("id", "root").join(ends, "root")
            far = compact(far.select("id", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "pointers")
            drop_settled(to)
            to = far
            if to.filter("moved").isEmpty():
                break
        if found is None:
            now = to.select("id", "root")
        else:
            renamed = to.select(F.col("id").alias("root"), F.col("root").alias("end"))
            now = found.join(renamed, "root", "left").select("id", F.coalesce("end", "root").alias("root"))
        found = compact(now, "components")
        a = to.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = to.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        left = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        rest = compact(left.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        drop_settled(edges, to)
        edges = rest
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return found


def _whole(docs: DataFrame) -> DataFrame:
    """docs with one text for each doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    again = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = again.count()
    if not n:
        return docs
    again = compact(again, "repeated-ids")
    smallest = by_ids(docs, again, "doc_id", "left_semi", n).groupBy("doc_id").agg(F.min("text").alias("text"))
    return by_ids(docs, again, "doc_id", "left_anti", n).unionByName(settled(smallest, "repeated-docs"))


def join(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id of every row of docs."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = _whole(docs)
    bits = min(p.most_bits, max(16, (whole.count() * p.sketch_slots).bit_length()))
    with small_batches(docs.sparkSession):
        first = held(_first_pass(whole, bits, p))
    named = first.filter("part is null").select("doc_id", "n", "fp")
    classes = named.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("c"))
    classes = compact(classes.filter("c > 1").drop("c"), "jaccard-classes")
    grouped = named.filter("n > 0").join(classes, "fp")
    copies = compact(grouped.filter("doc_id <> class_id").select("doc_id", "class_id"), "jaccard-copies")
    single = by_ids(whole, copies.select("doc_id"), "doc_id", "left_anti")
    levels = _sketch(first, bits)
    with small_batches(docs.sparkSession):
        postings = held(_postings(single, levels, p))
    shared = compact(_shared(postings, p), "jaccard-shared")
    postings.unpersist()
    h = F.col("h")
    star = shared.filter(F.col("id") != h["id"]).filter(
        _fits(p, F.col("n"), F.col("at"), F.col("k"), h["n"], h["at"], h["k"])
    )
    star = star.groupBy("id", h["id"].alias("hid")).agg(
        F.count(F.lit(1)).alias("matches"), F.min(F.least(F.col("k"), h["k"])).alias("least")
    ).filter("matches >= least")
    best = star.groupBy("id").agg(F.max(F.struct("matches", (-F.col("hid")).alias("hid"))).alias("m"))
    best = compact(best.select(F.col("id").alias("a"), (-F.col("m.hid")).alias("b")), "jaccard-stars")
    links = _verified(best, single, p)
    roots = components(links)
    postings, turn, before = shared.count(), 0, None
    while True:
        met, cost = _open_lists(shared, roots, p)
        if cost <= p.open_cost * postings or before is not None and cost > 0.8 * before:
            break
        more = _verified(_probes(met, turn, p), single, p)
        if more.isEmpty():
            break
        roots, turn, before = _joined(roots, more), turn + 1, cost
        drop_settled(met, more)
    pairs = _open_pairs(met, shared, best, p)
    more = _verified(pairs, single, p)
    if not more.isEmpty():
        roots = _joined(roots, more)
    drop_settled(classes, shared, best, links, met, pairs, more)

    out = named.join(copies, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(roots.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root", "class_id").alias("component_id")
    )
    if not every.filter("doc_id is null").isEmpty():
        nameless = _first_pass(every.filter("doc_id is null"), 16, p).filter("n is not null").select(
            F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"),
        )
        out = out.unionByName(nameless)
    return out
