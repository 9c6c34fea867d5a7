"""Relay hops, authentication claims and policies, evidence chains and case queries."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import net
from .ordered import slice_of

# ---- relay hops


def parsed_received(value: Column) -> Column:
    """from and by host, source IP, protocol and time of a Received header."""
    ip = F.coalesce(
        F.nullif(F.regexp_extract(value, r"\[([0-9]{1,3}(?:\.[0-9]{1,3}){3})\]", 1), F.lit("")),
        F.nullif(F.regexp_extract(value, r"\[(?:IPv6:)?([0-9a-fA-F:]{3,39})\]", 1), F.lit("")),
        F.nullif(F.regexp_extract(value, r"\(([0-9]{1,3}(?:\.[0-9]{1,3}){3})\)", 1), F.lit("")),
    )
    some = lambda p: F.nullif(F.regexp_extract(value, p, 1), F.lit(""))
    stamp = F.regexp_extract(value, r";\s*(?:[A-Za-z]{3},\s*)?([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8} [+-][0-9]{4})", 1)
    return F.struct(
        some(r"(?i)from\s+([^\s\[(;]+)").alias("from_host"), some(r"(?i)by\s+([^\s\[(;]+)").alias("by_host"), ip.alias("source_ip"),
        some(r"(?i)with\s+(E?SMTPS?A?|HTTPS?|LMTP)\b").alias("protocol"), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")).alias("timestamp"),
    )


def hop_flags(hops: DataFrame, email: str, position: str, ip: str, ts: str) -> DataFrame:
    """Adds delay_sec to the previous timed hop, backwards (earlier than it) and duplicate_ip (seen twice before)."""
    chain = W.partitionBy(email).orderBy(position)
    last = F.last(ts, ignorenulls=True).over(chain.rowsBetween(W.unboundedPreceding, -1))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    before = F.count(F.lit(1)).over(W.partitionBy(email, ip).orderBy(position).rowsBetween(W.unboundedPreceding, -1))
    return hops.withColumns({"delay_sec": seconds, "backwards": F.coalesce(seconds < 0, F.lit(False)), "duplicate_ip": before >= 2})


def hop_chain(flagged: DataFrame, email: str, ip: str, ts: str, private: Column) -> DataFrame:
    """A row for each message: hops, distinct public and private addresses, span, delays and anomalies."""
    pub, priv = F.countDistinct(F.when(~private, F.col(ip))), F.countDistinct(F.when(private, F.col(ip)))
    delay = F.when(F.col("delay_sec").isNotNull(), F.greatest(F.lit(0.0), F.col("delay_sec")))
    return flagged.groupBy(email).agg(
        F.count(F.lit(1)).alias("hops"), pub.alias("public_ips"), priv.alias("private_ips"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.round(F.max(delay), 6).alias("max_delay"), F.round(F.avg(delay), 6).alias("avg_delay"),
        F.bool_or("backwards").alias("non_monotonic_timestamps"), F.coalesce(F.bool_or(F.col("delay_sec") < -60), F.lit(False)).alias("ordering_anomaly"),
        F.bool_or("duplicate_ip").alias("duplicate_source_ip"), (pub > 8).alias("unusually_many_hops"),
    )


def first_public_hop(hops: DataFrame, email: str, position: str, ip: str, private: Column) -> DataFrame:
    return hops.filter(~private).groupBy(email).agg(F.min_by(ip, position).alias("first_public_ip"))


# ---- authentication


def tag_map(record: Column) -> Column:
    """tag=value; records as a map with trimmed lower-case tags."""
    pairs = F.filter(F.split(record, ";"), lambda x: x.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))


def auth_claim(header: Column, mechanism: str) -> Column:
    """Result that an Authentication-Results header claims for spf, dkim or dmarc; null for none."""
    return F.nullif(F.lower(F.regexp_extract(header, rf"(?i)(?:^|[;\s]){mechanism}\s*=\s*([a-z]+)", 1)), F.lit(""))


def dkim_structure(signature: Column) -> Column:
    """NONE without a signature, PERMERROR without d= or s=, else UNVERIFIED: keys and bodies are checked elsewhere."""
    tags = tag_map(signature)
    lacks = F.coalesce(F.try_element_at(tags, F.lit("d")), F.lit("")) == ""
    lacks = lacks | (F.coalesce(F.try_element_at(tags, F.lit("s")), F.lit("")) == "")
    return F.when(signature.isNull(), "NONE").when(lacks, "PERMERROR").otherwise("UNVERIFIED")


def aligned(a: Column, b: Column, mode: Column) -> Column:
    """Strict alignment is equality, relaxed is that of organisational domains."""
    relaxed = net.organizational_domain(a) == net.organizational_domain(b)
    return F.coalesce(F.when(F.coalesce(mode, F.lit("r")) == "s", a == b).otherwise(relaxed), F.lit(False))


def dmarc(from_domain: Column, spf: Column, spf_domain: Column, dkim: Column, dkim_domain: Column, record: Column) -> Column:
    """(result, policy, subdomain_policy, spf_aligned, dkim_aligned): a pass needs a mechanism that passes and is aligned."""
    tags = tag_map(record)
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    by_spf, by_dkim = aligned(from_domain, spf_domain, tag("aspf")), aligned(from_domain, dkim_domain, tag("adkim"))
    ok = ((spf == "PASS") & by_spf) | ((dkim == "PASS") & by_dkim)
    absent = record.isNull() | ~record.startswith("v=DMARC1")
    return F.struct(F.when(absent, "NONE").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("result"),
                    F.coalesce(tag("p"), F.lit("none")).alias("policy"), F.coalesce(tag("sp"), tag("p"), F.lit("none")).alias("subdomain_policy"), by_spf.alias("spf_aligned"), by_dkim.alias("dkim_aligned"))


class Spf:
    """Evaluates SPF records from a snapshot of DNS: {(name, type): [values]}."""

    RESULTS = {"+": "PASS", "-": "FAIL", "~": "SOFTFAIL", "?": "NEUTRAL"}

    def __init__(self, dns: dict[tuple[str, str], list[str]], most_lookups: int = 10) -> None:
        self.dns, self.most = dns, most_lookups

    def check(self, ip: str, domain: str) -> str:
        self.lookups = 0
        try:
            return self._evaluate(ipaddress.ip_address(ip), domain.lower().rstrip("."), ())
        except (ValueError, RecursionError):
            return "PERMERROR"

    def _look(self) -> None:
        self.lookups += 1
        if self.lookups > self.most:
            raise ValueError("too many lookups")

    def _evaluate(self, ip, domain: str, path: tuple[str, ...]) -> str:
        if domain in path:
            raise ValueError("loop")
        records = [r for r in self.dns.get((domain, "TXT"), []) if r.lower().split(" ")[0] == "v=spf1"]
        if not records:
            return "NONE"
        if len(records) > 1:
            raise ValueError("several records")
        redirect = None
        for term in records[0].split()[1:]:
            if term.lower().startswith("redirect="):
                redirect = term[9:].lower()
                continue
            sign, term = (term[0], term[1:]) if term[0] in self.RESULTS else ("+", term)
            name, value = re.fullmatch(r"([^:/]*):?(.*)", term).groups()
            if self._fits(ip, name.lower(), value, domain, path):
                return self.RESULTS[sign]
        if redirect:
            self._look()
            got = self._evaluate(ip, redirect, (*path, domain))
            if got == "NONE":
                raise ValueError("redirect to nothing")
            return got
        return "NEUTRAL"

    def _fits(self, ip, name: str, value: str, domain: str, path: tuple[str, ...]) -> bool:
        if name == "all":
            return True
        if name in ("ip4", "ip6"):
            return ip in ipaddress.ip_network(value, strict=False)
        if name in ("a", "mx"):
            self._look()
            host, _, bits = value.partition("/")
            host = (host or domain).lower()
            hosts = [host] if name == "a" else self.dns.get((host, "MX"), [])
            found = [x for h in hosts for x in self.dns.get((h.lower().rstrip("."), "AAAA" if ip.version == 6 else "A"), [])]
            # a/24//64: the part before // is for IPv4, the one after it for IPv6
            four, _, six = bits.partition("//") if "//" in bits else (bits, "", bits)
            bits = (six if ip.version == 6 else four).strip("/")
            return any(ip in ipaddress.ip_network(f"{x}/{bits}" if bits else x, strict=False) for x in found)
        if name == "exists":
            self._look()
            return bool(self.dns.get((value.lower(), "A")))
        if name == "include":
            self._look()
            got = self._evaluate(ip, value.lower(), (*path, domain))
            if got == "NONE":
                raise ValueError("include of nothing")
            return got == "PASS"
        return False


def spf(rows: DataFrame, ip: str, domain: str, dns: DataFrame, most_records: int = 200_000) -> DataFrame:
    """Adds spf. The DNS snapshot (name, type, value) goes to every executor: its TXT, MX, A and AAAA records are counted first,
    and more than most_records of them are an error, never a cut. Pass the records that the mail domains reach."""
    wanted = dns.filter(F.col("type").isin("TXT", "MX", "A", "AAAA"))
    found = wanted.limit(most_records + 1).collect()
    if len(found) > most_records:
        raise ValueError(f"more than {most_records} DNS records: cut the snapshot to the domains in question")
    table: dict[tuple[str, str], list[str]] = {}
    for r in found:
        table.setdefault((r["name"].lower(), r["type"]), []).append(r["value"])
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        engine = Spf(shared.value)
        for ips, domains in batches:
            yield pd.Series([engine.check(a, b) if a and b else "NONE" for a, b in zip(ips, domains, strict=True)])

    return rows.withColumn("spf", check(F.col(ip), F.col(domain)))


# ---- evidence and audit chains


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with sorted keys and the separators ", " and ": ", as it is hashed."""
    parts = []
    for k in sorted(fields):
        c = fields[k].cast("string")
        safe = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        quoted = F.concat(F.lit('"'), safe, F.lit('"'))
        parts.append(F.concat(F.lit(f'"{k}": '), F.coalesce(quoted, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def built_chain(rows: DataFrame, group: str, order: str, content_hash: str) -> DataFrame:
    """Hash chain within each group: chain = sha256(previous || content). The fold is sequential inside a group only."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content_hash).alias("h"))))
    start = F.struct(F.lit("GENESIS").alias("last"), F.array().cast("array<struct<o:bigint,previous_hash:string,chain_hash:string>>").alias("out"))
    step = lambda acc, x: F.struct(
        F.sha2(F.concat(acc["last"], x["h"]), 256).alias("last"),
        F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), acc["last"].alias("previous_hash"), F.sha2(F.concat(acc["last"], x["h"]), 256).alias("chain_hash")))).alias("out"),
    )
    folded = rows.groupBy(group).agg(items.alias("i")).select(group, F.explode(F.aggregate("i", start, step)["out"]).alias("c"))
    return folded.select(group, F.col("c.o").alias(order), "c.previous_hash", "c.chain_hash")


def verified_chain(rows: DataFrame, group: str | None, order: str) -> DataFrame:
    """Rows whose link or hash does not hold: previous_hash must be the chain_hash before it, chain_hash must fit.

    Without a group the log is one chain: links are compared inside ranges of `order`, and across their bounds by a
    join on the last row of each range, so that no task sorts the whole log.
    """
    if group is not None:
        before = F.lag("chain_hash", 1, "GENESIS").over(W.partitionBy(group).orderBy(order))
        checked = rows.withColumn("_before", before)
    else:
        parts = rows.withColumn("_part", slice_of(rows, F.col(order)))
        last = parts.groupBy("_part").agg(F.max_by("chain_hash", order).alias("_last"))
        last = last.withColumn("_bound", F.lag("_last", 1, "GENESIS").over(W.orderBy("_part"))).select("_part", "_bound")
        inside = F.lag("chain_hash").over(W.partitionBy("_part").orderBy(order))
        checked = parts.withColumn("_in", inside).join(F.broadcast(last), "_part").withColumn("_before", F.coalesce("_in", "_bound"))
    link = ~F.col("previous_hash").eqNullSafe(F.col("_before"))
    fits = F.col("chain_hash") == F.sha2(F.concat("previous_hash", "content_hash"), 256)
    keys = ([group] if group else []) + [order]
    return checked.filter(link | ~F.coalesce(fits, F.lit(False))).select(*keys, link.alias("broken_link"), (~F.coalesce(fits, F.lit(False))).alias("broken_hash"))


# ---- cases, budgets, limits


def case_counts(cases: DataFrame, emails: DataFrame, case: str, fk: str) -> DataFrame:
    n = emails.groupBy(F.col(fk).alias(case)).agg(F.count(F.lit(1)).alias("email_count"))
    return cases.join(n, case, "left").na.fill(0, ["email_count"])


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def latest(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(group).agg(F.max_by(F.struct(order, *columns), order).alias("r")).select(group, "r.*")


def budget(rows: DataFrame, group: str, order: list[Column], each: int, total: int | None = None) -> DataFrame:
    """The first `each` rows of a group; of those the first `total` over all."""
    kept = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= each)
    return kept.orderBy(F.col("_r"), F.col(group), *order).limit(total).drop("_r") if total else kept.drop("_r")


def rate_limited(requests: DataFrame, client: str, ts: str, seconds: int = 60, most: int = 30) -> DataFrame:
    """Adds recent (requests of the client in the window that ends here) and limited."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(client).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count(F.lit(1)).over(w)
    return requests.withColumns({"recent": n, "limited": n > most})
