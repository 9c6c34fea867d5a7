"""Sharding by balanced label propagation: documents with equal texts move towards one shard under row quotas.

Law `rows`: n documents in k shards give each shard n / k rows, rounded down or, for the first n mod k shards, up.

A document starts in the shard that a hash of its row names; the layout of the table has no part in it. In a round, each group of equal texts counts its members by
shard; the shard that holds most of it is its favourite. A group larger than a quota has as many favourites as hold it
with the room they have. Members elsewhere apply to a favourite, and each shard admits applicants, those of the largest
gain first, into its room under the quota and into the room that this round's departures free: `admitted` finds the
largest such set of moves from counts by (gain, from, to), at most k * k * 64 numbers. Rounds go on until one admits
hardly any move. Then groups of at most a quota that are still split leave their shards, and they, documents over a quota
and those without a linked document fill what room is left, group by group: a small group is cut only where the room of
one shard ends. Cut edges fall while sizes stay even to a row.

Everything is DataFrame joins and aggregates on (doc_id, size, hashes): texts are read once. Ranks within a shard are
counted in slices, so that no task holds a whole shard or group.

Edge cases: a null text has no bytes and CRC 0, like an empty one; null and empty texts are no links. Rows that repeat
a doc_id are placed one by one. Null doc_id are allowed. A text of any length is hashed whole. Extra columns are not read. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import numbered_repeats, ranked, settled


@dataclass(frozen=True)
class Shards:
    count: int = 40
    rounds: int = 100  # a guard: rounds end when one moves less than a thousandth of the linked documents
    overhead: int = 16  # bytes a row besides its text
    unit: int = 10_000  # groups up to so many rows keep together when they are placed at the end, in one task each


def rows_of(docs: DataFrame, p: Shards) -> DataFrame:
    """doc_id, size, text_crc32 and what the placement needs: a group key, a hash of the row."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + p.overhead).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("h1"),
    )


def admitted(counts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of counts[gain, from, to] applicants, how many of each may move: into a shard, its room and what leaves it at most.

    All applicants at first; a shard with too many keeps those of the largest gain, which lowers what leaves others, until
    none has too many. The order of the sources within a gain is that of the array.
    """
    now = counts
    wide = counts[::-1].reshape(-1, counts.shape[2])  # the largest gain first
    before = np.cumsum(wide, axis=0) - wide
    while True:
        most = np.maximum(0, room + now.sum(axis=(0, 2)))
        new = np.clip(most - before, 0, wide).reshape(counts.shape)[::-1]
        if (new == now).all():
            return now
        now = new


def place(docs: DataFrame, p: Shards = Shards()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row of docs."""
    k = p.count
    own = ["doc_id", F.col("doc_id").isNull(), "h1", "text_crc32", "size"]
    rows = numbered_repeats(rows_of(docs, p).withColumn("own", F.xxhash64(*own)), "own", "again")
    # 128 bits that name a row whatever file or partition it lies in; equal rows are told apart by their number
    key = F.struct(*[F.xxhash64(F.lit(i), *own, "again").alias(c) for i, c in enumerate("ab")])
    rows = settled(rows.withColumn("row", key).drop("own", "again"), "shard-rows")
    group = ["h1", "text_crc32", "size"]
    linked = rows.filter(F.col("size") > p.overhead).groupBy(*group).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    linked = settled(linked.withColumn("g", F.xxhash64(*group)), "shard-groups")
    total = rows.count()
    quota = F.lit(total // k) + (F.col("shard") < total % k).cast("long")
    shards = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("shard")).withColumn("quota", quota)

    base = max(total // k, 1)
    nodes = rows.join(linked, group).select("row", *group, "members", F.pmod(F.xxhash64("row"), F.lit(k)).cast("int").alias("shard"))
    nodes = settled(nodes, "shard-nodes")
    n_nodes = nodes.count()
    for r in range(p.rounds if n_nodes else 0):
        held = nodes.groupBy(*group, "members", "shard").agg(F.count(F.lit(1)).alias("here"))  # at most k rows a group
        load = nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
        room = shards.join(load, "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room"))
        room = dict(room.collect())  # k rows
        rooms = F.create_map(*[F.lit(x) for pair in sorted(room.items()) for x in pair])
        best = W.partitionBy(*group).orderBy(F.desc("here"), F.xxhash64(*group, "shard", F.lit(r)))
        places = held.withColumn("room", F.greatest(rooms[F.col("shard")], F.lit(0))).withColumn("rank", F.row_number().over(best))
        fits = F.coalesce(F.sum(F.col("here") + F.col("room")).over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        large = F.col("members") > base
        places = places.withColumn("fits", fits).filter((F.col("rank") == 1) | large & (F.col("fits") < F.col("members")))
        favourites = places.groupBy(*group).agg(F.collect_list(F.struct("rank", "shard", "here", "room")).alias("f"))  # at most k
        goals = held.select(*group, "members", "shard", "here").join(favourites, group)
        goals = goals.filter(~F.exists("f", lambda x: x["shard"] == F.col("shard")))
        goals = goals.withColumn("f", F.when(large, F.filter("f", lambda x: x["room"] > 0)).otherwise(F.col("f"))).filter(F.size("f") > 0)
        step = F.least(F.floor(2 * F.log2(F.col("to.here") - F.col("here") + 1)), F.lit(63))
        applied = settled(
            nodes.join(goals.drop("members"), [*group, "shard"])
            .withColumn("to", F.get("f", F.pmod(F.xxhash64("row", F.lit(7), F.lit(r)), F.size("f")).cast("int")))
            .select("row", F.col("to.shard").alias("goal"), ((step * k + F.col("shard")) * k + F.col("to.shard")).cast("int").alias("move")),
            "shard-moves",
        )
        counts = np.zeros(64 * k * k, dtype=np.int64)
        for move, n in applied.groupBy("move").agg(F.count(F.lit(1))).collect():  # at most 64 k k rows
            counts[move] = n
        most = admitted(counts.reshape(64, k, k), np.array([room[i] for i in range(k)])).reshape(-1)
        moves = int(most.sum())
        if moves:
            most = json.dumps([{"move": int(i), "most": int(most[i])} for i in most.nonzero()[0]])
            most = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(most), "array<struct<move int, most long>>")))
            place_in = ranked(applied, "move", [F.col("row")], F.xxhash64("row"), "rank", bits=4)
            moved = place_in.join(most, "move").filter("rank < most").select("row", "goal")
            moved = nodes.join(moved, "row", "left")
            nodes = settled(moved.withColumn("shard", F.coalesce("goal", "shard")).drop("goal"), "shard-nodes")
        if moves * 1000 < n_nodes:
            break

    # what fits one shard and is in several has no place yet; the rest is kept up to the quota, small groups as a whole
    small = F.col("members") <= min(base, p.unit)
    split = nodes.filter(small).groupBy(*group).agg(F.countDistinct("shard").alias("s")).filter("s > 1").select(*group)
    whole = nodes.join(split, group, "left_anti")
    unit = F.when(small, F.xxhash64(*group, F.lit(3))).otherwise(F.xxhash64("row", F.lit(3)))
    within = ranked(whole, "shard", [F.col("row")], unit, "rank").join(shards, "shard")
    kept = settled(within.filter("rank < quota").select("row", "shard"), "shard-kept")
    load = kept.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    gaps = shards.join(load, "shard", "left").withColumn("gap", F.col("quota") - F.coalesce("load", F.lit(0)))
    upto = F.sum("gap").over(W.orderBy("shard"))  # k rows
    gaps = settled(gaps.withColumn("upto", upto).filter("gap > 0").select("shard", "gap", "upto"), "shard-gaps")
    ends = gaps.agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))  # k entries
    # groups first, side by side; then rows of their own
    free = rows.select("row").join(kept, "row", "left_anti")
    free = free.join(nodes.filter(small).select("row", F.xxhash64(*group, F.lit(5)).alias("unit")), "row", "left").withColumn("all", F.lit(0))
    apart = F.shiftrightunsigned(F.xxhash64("row", F.lit(5)), 1).bitwiseOR(F.lit(-(1 << 63)))
    spread = F.coalesce(F.shiftrightunsigned("unit", 1), apart)
    free = ranked(free, "all", [F.col("row")], spread, "n", bits=16)
    free = free.withColumn("ends", ends.scalar())
    shard = F.get(F.filter("ends", lambda e: e["upto"] > F.col("n")), F.lit(0))["shard"]
    filled = free.select("row", shard.alias("shard"))
    placed = rows.join(kept.unionByName(filled), "row")
    placed = ranked(placed, "shard", [F.col("doc_id"), F.col("row")], F.xxhash64("row", F.lit(9)), "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_edges(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: links (documents less groups) and cuts (shards that groups touch, less groups)."""
    group = ["size", "text_crc32"]
    by = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("s")).filter("n > 1")
    return by.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("s") - 1).alias("cuts"))
