"""The entity graph: nodes and edges from mail records, path joins, shared infrastructure, traversal, campaigns, hunting.

Nodes are (node_id, node_type, canonical_value, first_seen, last_seen, source_count, confidence), edges are (source,
target, relationship_type, confidence, first_seen, last_seen, observation_count, email_id). Iterative operators take
`settle`, which writes a frame to the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

Settle = Callable[[DataFrame], DataFrame]

# Edge types of mail records.
SENT_FROM, USES_DOMAIN, PART_OF_CASE = "SENT_FROM", "USES_DOMAIN", "PART_OF_CASE"
RECEIVED_FROM_IP, CONTAINS_URL, CONTAINS_DOMAIN = "RECEIVED_FROM_IP", "CONTAINS_URL", "CONTAINS_DOMAIN"
BELONGS_TO_DOMAIN, SENT_TO, CONTAINS_EMAIL = "BELONGS_TO_DOMAIN", "SENT_TO", "CONTAINS_EMAIL"
HAS_ATTACHMENT, HAS_FILE_HASH, ASSOCIATED_WITH_CASE = "HAS_ATTACHMENT", "HAS_FILE_HASH", "ASSOCIATED_WITH_CASE"


def _micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp, with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def node_id(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, value), 256)


def nodes_of(sightings: DataFrame) -> DataFrame:
    """Upsert of (node_type, canonical_value, seen_at, confidence): one row a value, best confidence, span, count."""
    kept = sightings.filter("canonical_value is not null and canonical_value <> ''")
    out = kept.groupBy("node_type", "canonical_value").agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
        F.count(F.lit(1)).alias("source_count"), F.max("confidence").alias("confidence"),
    )
    return out.withColumn("node_id", node_id(F.col("node_type"), F.col("canonical_value")))


def edges_of(observed: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """Observed edges are one row for each (source, target, type); inferred ones may repeat."""
    out = observed.groupBy("source", "target", "relationship_type").agg(
        F.max("confidence").alias("confidence"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
        F.count(F.lit(1)).alias("observation_count"), F.min("email_id").alias("email_id"),
    ).withColumn("is_inferred", F.lit(False))
    if inferred is None:
        return out
    more = inferred.select(
        "source", "target", "relationship_type", "confidence", F.col("seen_at").alias("first_seen"),
        F.col("seen_at").alias("last_seen"), F.lit(1).cast("long").alias("observation_count"), "email_id", F.lit(True).alias("is_inferred"),
    )
    return out.unionByName(more)


def mail_graph(mail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of mail records: email_id, seen_at, sender, case_id, ips, urls, domains, addresses, recipients,
    attachments (an array of filename and sha256). All arrays may be null."""
    email = F.col("email_id").cast("string")
    base = mail.withColumn("e", email).withColumn("sender_domain", F.lower(F.substring_index("sender", "@", -1)))
    parts: list[DataFrame] = []

    def link(rows: DataFrame, kind_a: str, a: Column, rel: str, kind_b: str, b: Column, confidence: float) -> None:
        parts.append(rows.select(
            F.lit(kind_a).alias("ka"), a.alias("va"), F.lit(rel).alias("relationship_type"), F.lit(kind_b).alias("kb"),
            b.alias("vb"), F.lit(confidence).alias("confidence"), "seen_at", "email_id",
        ))

    e = F.col("e")
    link(base, "EMAIL", e, SENT_FROM, "SENDER", F.lower("sender"), 1.0)
    link(base, "SENDER", F.lower("sender"), USES_DOMAIN, "DOMAIN", F.col("sender_domain"), 1.0)
    link(base, "EMAIL", e, PART_OF_CASE, "CASE", F.col("case_id").cast("string"), 1.0)
    x = F.col("x")
    for column, kind, rel in (
        ("ips", "IPV4", RECEIVED_FROM_IP), ("urls", "URL", CONTAINS_URL), ("domains", "DOMAIN", CONTAINS_DOMAIN),
        ("addresses", "EMAIL_ADDRESS", CONTAINS_EMAIL), ("recipients", "EMAIL_ADDRESS", SENT_TO),
    ):
        link(base.withColumn("x", F.explode(column)), "EMAIL", e, rel, kind, x, 0.9)
    by_url = base.withColumn("x", F.explode("urls")).withColumn("h", F.lower(F.regexp_extract("x", r"^[A-Za-z]+://([^/:?#]*)", 1)))
    link(by_url, "URL", x, BELONGS_TO_DOMAIN, "DOMAIN", F.col("h"), 0.9)
    att = base.withColumn("x", F.explode("attachments"))
    name = F.concat_ws(":", "e", F.col("x.filename"))
    link(att, "EMAIL", e, HAS_ATTACHMENT, "ATTACHMENT", name, 1.0)
    link(att, "ATTACHMENT", name, HAS_FILE_HASH, "FILE_HASH", F.lower(F.col("x.sha256")), 1.0)
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    links = links.filter("va is not null and va <> '' and vb is not null and vb <> ''")
    ends = links.select(F.explode(F.array(
        F.struct(F.col("ka").alias("node_type"), F.col("va").alias("canonical_value")),
        F.struct(F.col("kb").alias("node_type"), F.col("vb").alias("canonical_value")),
    )).alias("n"), "seen_at", "confidence")
    nodes = nodes_of(ends.select("n.*", "seen_at", "confidence"))
    observed = links.select(
        node_id(F.col("ka"), F.col("va")).alias("source"), node_id(F.col("kb"), F.col("vb")).alias("target"),
        "relationship_type", "confidence", "seen_at", "email_id",
    )
    return nodes, edges_of(observed)


# ---- joins along paths


def one_hop(edges: DataFrame, rel: str) -> DataFrame:
    return edges.filter(F.col("relationship_type") == rel).select("source", "target").distinct()


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(source, middle, target)."""
    a = one_hop(edges, first).withColumnRenamed("target", "middle")
    return a.join(one_hop(edges, second).withColumnRenamed("source", "middle"), "middle").select("source", "middle", "target")


def emails_by(edges: DataFrame, nodes: DataFrame, kind: str, value: str) -> DataFrame:
    """Emails that carry a URL, IP or hash, or that use a domain, through a link or the sender."""
    target = nodes.filter((F.col("node_type") == kind) & (F.col("canonical_value") == value)).select(F.col("node_id").alias("target"))
    direct = edges.join(target, "target", "left_semi").filter(F.col("relationship_type").isin(CONTAINS_URL, RECEIVED_FROM_IP, CONTAINS_DOMAIN)).select("source")
    sender = two_hops(edges, SENT_FROM, USES_DOMAIN).join(target, "target", "left_semi").select("source")
    file = two_hops(edges, HAS_ATTACHMENT, HAS_FILE_HASH).join(target, "target", "left_semi").select("source")
    return direct.unionByName(sender).unionByName(file).distinct()


def shared_infrastructure(links: DataFrame, email: str, ioc: list[str], least: int = 2) -> DataFrame:
    """Indicators seen in several emails, with their count. The list of emails is left to `emails_of`, for it has no bound."""
    counts = links.groupBy(*ioc).agg(F.countDistinct(email).alias("email_count"))
    return counts.filter(F.col("email_count") >= least)


def emails_of(links: DataFrame, shared: DataFrame, ioc: list[str]) -> DataFrame:
    return links.join(shared.select(*ioc), ioc, "left_semi").distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("node_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    e = edges.groupBy(F.col("relationship_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON element a row: a node or an edge as a graph viewer reads it."""
    n = nodes.select(F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.col("canonical_value").alias("label")).alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.lit("edges").alias("group"), F.struct("source", "target", F.col("relationship_type").alias("label")).alias("data"))).alias("element"))
    return n.unionByName(e)


def visible_subgraph(nodes: DataFrame, edges: DataFrame, kinds: list[str], label: str = "") -> tuple[DataFrame, DataFrame]:
    n = nodes.filter(F.col("node_type").isin(kinds) & F.lower("canonical_value").contains(label.lower()))
    keep = n.select("node_id")
    e = edges.join(keep.withColumnRenamed("node_id", "source"), "source", "left_semi").join(keep.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return n, e


def degrees(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


# ---- traversal


def bfs_levels(edges: DataFrame, start: DataFrame, depth: int, settle: Settle, fan_out: int | None = None, directed: bool = True) -> DataFrame:
    """(node, level) reached from start (node); with fan_out each node follows only that many edges, in order of target."""
    links = edges.select("source", "target")
    if not directed:
        links = links.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    links = links.distinct()
    if fan_out is not None:
        links = links.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("target"))).filter(F.col("r") <= fan_out).drop("r")
    seen = settle(start.select("node", F.lit(0).alias("level")).distinct())
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(links, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = settle(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = settle(seen.unionByName(frontier))
    return seen


def shortest_path_length(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int, settle: Settle) -> DataFrame:
    """(node, level) of the goals that are within depth."""
    return bfs_levels(edges, start, depth, settle).join(goal, "node", "left_semi")


def components(edges: DataFrame, settle: Settle) -> DataFrame:
    """(node, component): the smallest node that undirected edges (a, b) reach, by contraction of the graph."""
    edges = settle(edges.select("a", "b").filter("a <> b").distinct())
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
        while True:
            ends = to.select(F.col("node").alias("component"), F.col("component").alias("end"))
            far = settle(to.join(ends, "component").select("node", F.col("end").alias("component"), (F.col("end") != F.col("component")).alias("moved")))
            to = far.select("node", "component")
            if far.filter("moved").isEmpty():
                break
        if found is None:
            found = to
        else:
            ends = to.select(F.col("node").alias("component"), F.col("component").alias("end"))
            found = settle(found.join(ends, "component", "left").select("node", F.coalesce("end", "component").alias("component")))
        ra, rb = to.select(F.col("node").alias("a"), F.col("component").alias("ra")), to.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        edges = settle(edges.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


# ---- timelines and correlation


def ioc_timeline(sightings: DataFrame, ioc: list[str], entity: str, ts: str) -> DataFrame:
    span = (_micros(F.max(ts)) - _micros(F.min(ts))) / 86_400_000_000
    return sightings.groupBy(*ioc).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("observations"),
        F.countDistinct(entity).alias("entities"), F.round(span, 6).alias("duration_days"),
    )


def trending(timeline: DataFrame, as_of: Column, days: int, limit: int, tie: list[str]) -> DataFrame:
    recent = timeline.filter(F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.orderBy(F.desc("last_seen"), F.desc("observations"), *tie).limit(limit)


def lifetime_stats(timeline: DataFrame, as_of: Column, recent_days: int = 30) -> DataFrame:
    """Spread of lifetimes in days; p90 and p95 are nearest-rank values and null for fewer than 10 and 20 indicators."""
    d, n = F.col("duration_days"), F.count(F.lit(1))
    ranked = lambda p, least: F.when(n >= least, F.get(F.array_sort(F.collect_list(d)), F.least(F.floor(n * p), n - 1).cast("int")))
    active = F.count_if(F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(recent_days)))
    return timeline.agg(
        n.alias("n"), F.round(F.min(d), 4).alias("min_days"), F.round(F.max(d), 4).alias("max_days"), F.round(F.avg(d), 4).alias("mean_days"),
        F.round(F.median(d), 4).alias("median_days"), F.round(ranked(0.9, 10), 4).alias("p90_days"), F.round(ranked(0.95, 20), 4).alias("p95_days"),
        active.alias("active"), F.round(100 * active / n, 4).alias("active_pct"),
    )


def temporal_correlation(sightings: DataFrame, ioc: str, entity: str, ts: str, window_hours: float = 24.0) -> DataFrame:
    """(a, b, score, level) of indicators that share an entity: 0.7 Jaccard of entities + 0.3 nearness of first sight."""
    first = sightings.groupBy(ioc).agg(F.min(ts).alias("first"), F.countDistinct(entity).alias("size"))
    pairs = sightings.select(ioc, entity).distinct()
    met = pairs.alias("x").join(pairs.alias("y"), (F.col(f"x.{entity}") == F.col(f"y.{entity}")) & (F.col(f"x.{ioc}") < F.col(f"y.{ioc}")))
    met = met.groupBy(F.col(f"x.{ioc}").alias("a"), F.col(f"y.{ioc}").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    of = lambda c: first.select(F.col(ioc).alias(c), F.col("first").alias(f"f{c}"), F.col("size").alias(f"s{c}"))
    met = met.join(of("a"), "a").join(of("b"), "b")
    jaccard = F.col("common") / (F.col("sa") + F.col("sb") - F.col("common"))
    hours = F.abs(_micros("fa") - _micros("fb")) / 3_600_000_000
    score = 0.7 * jaccard + 0.3 * F.greatest(F.lit(0.0), 1 - hours / window_hours)
    level = F.when(score > 0.7, "high").when(score > 0.3, "medium").otherwise("low")
    return met.select("a", "b", "common", F.round(score, 6).alias("score"), level.alias("level"))


def email_similarity(pairs: DataFrame) -> DataFrame:
    """Mean of same sender domain, Jaccard of subject words, Jaccard of recipients and nearness of dates for rows with
    domain_a/b, words_a/b, to_a/b and days (the distance of their dates)."""
    jac = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    near = F.when(F.col("days") <= 1, 1.0).when(F.col("days") <= 7, 0.5).otherwise(0.0)
    score = ((F.col("domain_a") == F.col("domain_b")).cast("double") + jac("words_a", "words_b") + jac("to_a", "to_b") + near) / 4
    return pairs.withColumn("similarity", F.round(score, 6))


def similar_emails(emails: DataFrame, by: str, settle: Settle, most_ids: int = 2_048) -> DataFrame:
    """(a, b, similarity): email_similarity of every pair a < b of emails (id, by, domain, words, to, day) with the same `by`.

    Emails with the same four features score alike, so each pair of such groups is scored once and then listed by id.
    Groups are cut into lists of some `most_ids` ids, and those of one value of `by` are dealt to several tasks.
    """
    emails = emails.filter(F.col("id").isNotNull() & F.col(by).isNotNull())
    features = [by, "domain", "words", "to", "day"]
    largest = lambda *keys: emails.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    lists, slices = -(-largest(*features) // most_ids) or 1, min(32, -(-largest(by) // 256) or 1)
    groups = emails.groupBy(*features, F.pmod(F.xxhash64("id"), F.lit(lists)).alias("list")).agg(F.collect_list("id").alias("ids"))
    groups = settle(groups.withColumn("g", F.monotonically_increasing_id()))
    of = lambda c: groups.select(by, *[F.col(n).alias(f"{n}_{c}") for n in ("g", "ids", "domain", "words", "to", "day")])
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, for few bytes here make many rows
    a = of("a").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, by, "slice")
    b = of("b").withColumn("slice", F.pmod(F.xxhash64("g_b"), F.lit(slices)).cast("int"))
    scored = email_similarity(a.join(b, [by, "slice"]).filter("g_a <= g_b").withColumn("days", F.abs(F.col("day_a") - F.col("day_b"))))
    # always true; makes generated code score a pair of groups before the loops over their ids, not within
    scored = scored.withColumn("here", F.spark_partition_id()).filter("here >= 0 and similarity is not null")
    each = scored.select("g_a", "g_b", "similarity", "ids_b", F.explode("ids_a").alias("x")).select("g_a", "g_b", "similarity", "x", F.explode("ids_b").alias("y"))
    each = each.filter("x < y or g_a < g_b and x > y")  # a list with itself: each pair once
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


# ---- campaigns and hunting


def campaign_id(ids: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(ids), "_")), 1, 12)


def _in_lists(links: DataFrame, email: str, ioc: list[str]) -> DataFrame:
    """Distinct links of indicators that several emails have, with the list's length n and its first email."""
    each = links.select(email, *ioc).distinct()
    counts = each.groupBy(*ioc).agg(F.count(F.lit(1)).alias("n"), F.min(email).alias("first"))
    return each.join(counts.filter("n > 1"), ioc)


def campaign_pairs(links: DataFrame, email: str, ioc: list[str], least_shared: int) -> DataFrame:
    """(a, b, shared): every pair of emails that share `least_shared` indicators."""
    each = _in_lists(links, email, ioc)
    x, y = each.alias("x"), each.alias("y")
    same = F.lit(True)
    for c in ioc:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    pairs = x.join(y, same & (F.col(f"x.{email}") < F.col(f"y.{email}"))).select(F.col(f"x.{email}").alias("a"), F.col(f"y.{email}").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared)


def campaign_links(links: DataFrame, email: str, ioc: list[str]) -> DataFrame:
    """(a, b): each email with the first one of each of its indicators. For components alone: they are those of all pairs."""
    each = _in_lists(links, email, ioc).filter(F.col(email) != F.col("first"))
    return each.select(F.col("first").alias("a"), F.col(email).alias("b")).distinct()


def campaign_stars(pairs: DataFrame, least_emails: int) -> DataFrame:
    """Each seed with the emails it shares enough with: (seed, emails), seed included."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("seed")).agg((F.countDistinct("b") + 1).alias("emails")).filter(F.col("emails") >= least_emails)


def _sharing_sets(links: DataFrame, email: str, ioc: list[str], least_shared: int, settle: Settle) -> tuple[DataFrame, DataFrame]:
    """Emails with `least_shared` shared indicators or more, as sets of numbered indicators: (first, n, iocs) for each
    distinct set with its smallest email and count, and (email, first) for each email."""
    each = links.select(email, *ioc).distinct().filter(F.col(email).isNotNull())
    lists = each.groupBy(*ioc).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    numbered = settle(lists.withColumn("_i", F.monotonically_increasing_id()))
    sets = each.join(numbered, ioc).groupBy(F.col(email).alias("email")).agg(F.sort_array(F.collect_list("_i")).alias("iocs"))
    sets = settle(sets.filter(F.size("iocs") >= least_shared))
    classes = settle(sets.groupBy("iocs").agg(F.min("email").alias("first"), F.count(F.lit(1)).alias("n")))
    return classes, settle(sets.join(classes.drop("n"), "iocs").select("email", "first"))


def _by_cells(classes: DataFrame, least_shared: int, found: str, schema: str, most_links: int) -> DataFrame:
    """Counts shared indicators of all pairs of classes, a cell of two blocks of some `most_links` links at a time, in arrays
    that hold one class against a block: pairs are neither shuffled nor kept. `found`: "emails" or "edges" (see _in_cell)."""
    total = classes.agg(F.sum(F.size("iocs"))).first()[0] or 0
    blocks = -(-total // most_links) or 1
    block = F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int")
    dealt = classes.withColumn("x", block).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("left", F.col("x") <= F.col("y")).withColumn("right", F.col("x") >= F.col("y"))
    dealt = dealt.withColumn("cell", F.least("x", "y") * F.lit(blocks).cast("long") + F.greatest("x", "y"))
    tasks = max(1, min(blocks * (blocks + 1) // 2, 2_000))
    dealt = dealt.select("cell", "left", "right", "first", "n", "iocs").repartition(tasks, "cell")
    return dealt.groupBy("cell").applyInPandas(lambda rows: _in_cell(rows, least_shared, found), schema)


def _in_cell(rows, least_shared: int, found: str):
    """Of one cell, whose left rows meet its right rows: (first, emails), the emails of linked classes by class, or (a, b), a
    forest with the components of the links. Rows that are left and right meet each other."""
    import numpy as np
    import pandas as pd

    n, sizes = rows["n"].to_numpy(), rows["iocs"].map(len).to_numpy()
    iocs = np.unique(np.concatenate(rows["iocs"].to_numpy()), return_inverse=True)[1]
    row = np.repeat(np.arange(len(rows)), sizes)
    right = np.flatnonzero(rows["right"].to_numpy())
    place = np.full(len(rows), -1)
    place[right] = np.arange(len(right))
    on_right = place[row] >= 0
    order = np.argsort(iocs[on_right], kind="stable")
    posting = place[row[on_right]][order].astype(np.int32)
    ends = np.searchsorted(iocs[on_right][order], np.arange(iocs.max() + 2))
    lists = [posting[a:b] for a, b in zip(ends[:-1], ends[1:])]
    starts = np.append(0, np.cumsum(sizes))
    emails, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for i in np.flatnonzero(rows["left"].to_numpy()):
        met = np.concatenate([lists[k] for k in iocs[starts[i] : starts[i + 1]]])
        near = right[np.bincount(met, minlength=len(right)) >= least_shared]
        if place[i] >= 0:
            near = near[near != i]
        if found == "emails":
            emails[i] += n[near].sum()
            if place[i] < 0:
                emails[near] += n[i]
        elif len(near) and (label[near] != label[i]).any():
            roots = np.append(label[near], label[i])
            to = np.arange(len(rows))
            to[roots] = roots.min()
            label = to[label]
    if found == "emails":
        return pd.DataFrame({"first": rows["first"], "emails": emails})[emails > 0]
    joined = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({"a": rows["first"].to_numpy()[label[joined]], "b": rows["first"].to_numpy()[joined]})


def campaign_seeds(links: DataFrame, email: str, ioc: list[str], least_shared: int, least_emails: int, settle: Settle, most_links: int = 1 << 20) -> DataFrame:
    """campaign_stars of campaign_pairs, (seed, emails), without listing pairs."""
    classes, members = _sharing_sets(links, email, ioc, least_shared, settle)
    kind = classes.schema["first"].dataType.simpleString()
    others = _by_cells(classes, least_shared, "emails", f"first {kind}, emails long", most_links)
    own = classes.select("first", F.col("n").alias("emails"))  # emails of one set share all of it
    emails = others.unionByName(own).groupBy("first").agg(F.sum("emails").alias("emails")).filter(F.col("emails") >= least_emails)
    # an email alone is no seed, whatever the least
    return members.join(emails.filter("emails > 1"), "first").select(F.col("email").alias("seed"), "emails")


def campaign_components(links: DataFrame, email: str, ioc: list[str], least_shared: int, settle: Settle, most_links: int = 1 << 20) -> DataFrame:
    """components of campaign_pairs, (node, component), from a forest of each cell instead of its pairs."""
    classes, members = _sharing_sets(links, email, ioc, least_shared, settle)
    kind = classes.schema["first"].dataType.simpleString()
    between = _by_cells(classes, least_shared, "edges", f"a {kind}, b {kind}", most_links)
    return components(between.unionByName(members.select(F.col("first").alias("a"), F.col("email").alias("b"))), settle)


def campaign_score(emails: Column, iocs: Column, temporal: Column, rarity: Column) -> Column:
    base = F.least(F.lit(1.0), 0.1 * emails + 0.05 * iocs)
    return base * (0.5 + 0.3 * temporal + 0.2 * rarity)


def temporal_concentration(first: Column, last: Column, window_days: float) -> Column:
    span = (_micros(last) - _micros(first)) / 86_400_000_000
    return F.greatest(F.lit(0.0), 1 - span / window_days)


def rarity(n: Column) -> Column:
    """Of indicators seen n times each: the mean is one minus the capped share of 100 sightings."""
    return F.avg(1 - F.least(F.lit(1.0), n / 100))


def hunt(links: DataFrame, email: str, ioc: str, wanted: list[str], require: bool = True) -> DataFrame:
    """Emails that carry all wanted indicators (require), or any."""
    hit = links.filter(F.col(ioc).isin(wanted)).groupBy(email).agg(F.countDistinct(ioc).alias("matched"))
    return hit.filter(F.col("matched") == len(set(wanted))) if require else hit


def with_and_without(emails: DataFrame, links: DataFrame, email: str, present: bool) -> DataFrame:
    return emails.join(links.select(email), email, "left_semi" if present else "left_anti")


def reputation(findings: DataFrame, target: str) -> DataFrame:
    """Sum of w * confidence over sum of w, w being reliability times confidence."""
    w = F.col("reliability") * F.col("confidence")
    score = F.try_divide(F.sum(w * F.col("confidence")), F.sum(w))
    n = F.count_if(F.col("confidence") >= 0.5)
    level = F.when(n > 3, "high").when(n > 0, "medium").otherwise("low")
    return findings.groupBy(target).agg(F.round(score, 6).alias("reputation"), F.count(F.lit(1)).alias("reports"), level.alias("correlation"))
