"""Stateful streams: windows with watermarks, circuit breakers, token buckets, chains, upserts; and their batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


# ---- windows


def tumbling_counts(events: DataFrame, ts: str, key: str, length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Sightings by window and key; with `late` a stream drops what arrives after the watermark."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total"
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"
    )


# ---- circuit breaker: a state machine in a fold

BREAKER = "struct<state:string,failures:int,successes:int,opened:double,rejected:int>"


def breaker_step(most_failures: int = 5, wait: float = 60.0, needed: int = 2):
    """The step of a breaker over calls struct(at seconds, ok): closed, open for `wait` seconds, then half open."""

    def step(s: Column, x: Column) -> Column:
        waiting = (s["state"] == "open") & (x["at"] - s["opened"] < wait)
        half = ~waiting & s["state"].isin("open", "half_open")
        good = F.when(half, s["successes"] + 1).otherwise(0)
        bad = s["failures"] + 1
        new = lambda state, f, g, at, r: F.struct(
            state.alias("state"), f.cast("int").alias("failures"), g.cast("int").alias("successes"), at.cast("double").alias("opened"), r.cast("int").alias("rejected"))
        passed = new(F.when(half & (good < needed), "half_open").otherwise("closed"), F.lit(0), F.when(half & (good < needed), good).otherwise(F.lit(0)), s["opened"], s["rejected"])
        trips = half | (bad >= most_failures)
        failed = new(F.when(trips, "open").otherwise("closed"), F.when(trips, F.lit(0)).otherwise(bad), F.lit(0), F.when(trips, x["at"]).otherwise(s["opened"]), s["rejected"])
        held = new(s["state"], s["failures"], s["successes"], s["opened"], s["rejected"] + 1)
        return F.when(waiting, held).when(x["ok"], passed).otherwise(failed)

    return step


def breaker_states(calls: DataFrame, key: str, ts: str, ok: Column, **settings) -> DataFrame:
    """Final state of each provider's breaker; the fold is sequential within a provider only."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    items = F.array_sort(F.collect_list(F.struct(at.alias("at"), ok.alias("ok"))))
    start = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(0).alias("successes"), F.lit(0.0).alias("opened"), F.lit(0).alias("rejected")).cast(BREAKER)
    return calls.groupBy(key).agg(items.alias("i")).select(key, F.aggregate("i", start, breaker_step(**settings)).alias("s")).select(key, "s.*")


class Breaker:
    """The same machine for a stream, one call at a time."""

    def __init__(self, state: str = "closed", failures: int = 0, successes: int = 0, opened: float = 0.0, rejected: int = 0) -> None:
        self.state, self.failures, self.successes, self.opened, self.rejected = state, failures, successes, opened, rejected

    def call(self, at: float, ok: bool, most_failures: int = 5, wait: float = 60.0, needed: int = 2) -> None:
        if self.state == "open" and at - self.opened < wait:
            self.rejected += 1
            return
        half = self.state != "closed"
        if ok:
            good = self.successes + 1 if half else 0
            self.state, self.failures, self.successes = ("half_open", 0, good) if half and good < needed else ("closed", 0, 0)
        elif half or self.failures + 1 >= most_failures:
            self.state, self.failures, self.successes, self.opened = "open", 0, 0, at
        else:
            self.failures, self.successes = self.failures + 1, 0

    def row(self) -> tuple:
        return self.state, self.failures, self.successes, self.opened, self.rejected


STATE = "state string, failures int, successes int, opened double, rejected int"


def stream_breaker(calls: DataFrame) -> DataFrame:
    """Breaker states of a stream of (provider, at, ok), one row a provider and trigger."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(batches)).sort_values("at")
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            b.call(float(at), bool(ok))
        state.update(b.row())
        yield pd.DataFrame([(key[0], *b.row())], columns=["provider", *[x.split()[0] for x in STATE.split(", ")]])

    return calls.groupBy("provider").applyInPandasWithState(update, f"provider string, {STATE}", STATE, "update", "NoTimeout")


# ---- token bucket


def token_bucket(requests: DataFrame, key: str, ts: str, capacity: float, per_second: float) -> DataFrame:
    """(key, allowed, denied, tokens): a bucket that refills at a constant rate; sequential within a key only."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    items = F.array_sort(F.collect_list(at))
    kind = "struct<tokens:double,last:double,allowed:int,denied:int>"
    start = F.struct(F.lit(capacity).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("allowed"), F.lit(0).alias("denied")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        have = F.least(F.lit(capacity), s["tokens"] + F.coalesce(x - s["last"], F.lit(0.0)) * per_second)
        ok = have >= 1
        return F.struct(F.when(ok, have - 1).otherwise(have).alias("tokens"), x.alias("last"), (s["allowed"] + ok.cast("int")).alias("allowed"), (s["denied"] + (~ok).cast("int")).alias("denied")).cast(kind)

    return requests.groupBy(key).agg(items.alias("i")).select(key, F.aggregate("i", start, step).alias("s")).select(key, "s.allowed", "s.denied", F.round("s.tokens", 6).alias("tokens"))


# ---- upserts and chains of streams


def upsert_sink(path: str, keys: list[str]):
    """For foreachBatch: merges (keys, seen_at) counts into a table of first_seen, last_seen, n kept as parquet versions.

    Each batch writes a whole new version named by its epoch; a batch that is run again writes the same version.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("n"))
        if epoch:
            new = spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(new)
        new.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return merge


def stream_chain(rows: DataFrame) -> DataFrame:
    """Evidence rows (group string, order long, content_hash string) with their links, the last hash being kept as state."""
    import hashlib

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else "GENESIS"
        rows = pd.concat(list(batches)).sort_values("order")
        out = []
        for order, content in zip(rows["order"], rows["content_hash"], strict=True):
            chain = hashlib.sha256((last + content).encode()).hexdigest()
            out.append((key[0], int(order), last, chain))
            last = chain
        state.update((last,))
        yield pd.DataFrame(out, columns=["group", "order", "previous_hash", "chain_hash"])

    return rows.groupBy("group").applyInPandasWithState(update, "group string, order long, previous_hash string, chain_hash string", "last string", "append", "NoTimeout")
