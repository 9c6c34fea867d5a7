"""Indicators and threat intelligence: normalisation, provider answers, agreement, confidence, freshness, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import net

DEFINITIVE = ["BENIGN", "SUSPICIOUS", "MALICIOUS"]
FINDINGS = "provider string, ioc_type string, ioc_value string, verdict string, confidence double, categories array<string>, detections int, total_engines int"

# Report categories of address reputation by number.
ABUSE_CATEGORIES = {3: "Fraud Orders", 4: "DDoS Attack", 5: "FTP Brute-Force", 6: "Ping of Death", 7: "Phishing", 8: "Fraud VoIP", 9: "Open Proxy", 10: "Web Spam", 11: "Email Spam", 12: "Blog Spam", 13: "VPN IP", 14: "Port Scan", 15: "Hacking", 16: "SQL Injection", 17: "Spoofing", 18: "Brute-Force", 19: "Bad Web Bot", 20: "Exploited Host", 21: "Web App Attack", 22: "SSH", 23: "IoT Targeted"}


def ioc(value: Column) -> Column:
    """(ioc_type, normalized_value): hash, IPv4, IPv6, e-mail address, URL, domain, tried in that order; null if none."""

    def typed(v: Column, v4: Column, v6: Column) -> Column:
        return F.struct(
            F.when(net.hash_type(v).isNotNull(), F.lit("FILE_HASH")).when(v4.isNotNull(), "IPV4").when(v6.isNotNull(), "IPV6").when(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "EMAIL")
            .when(v.rlike(r"(?i)^https?://[^/\s]+"), "URL").when(v.rlike(r"^(?i)([a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?\.)+[a-z0-9-]{2,}\.?$"), "DOMAIN").alias("k"), v.alias("v"), v4.alias("v4"), v6.alias("v6"))

    def normal(t: Column) -> Column:
        k, v = t["k"], t["v"]
        norm = F.when(k == "IPV4", t["v4"]).when(k == "IPV6", t["v6"]).when(k == "URL", net.normalized_url(v)).when(k == "DOMAIN", net.normalized_domain(v)).otherwise(F.lower(v))
        return F.struct(k.alias("ioc_type"), norm.alias("normalized_value"))

    each = net.bound(F.trim(value), lambda v: F.struct(v.alias("v"), net.normalized_ipv4(v).alias("v4"), net.compressed_ipv6(v).alias("v6")))
    return net.bound(net.bound(each, lambda t: typed(t["v"], t["v4"], t["v6"])), normal)


def distinct_iocs(values: DataFrame, column: str) -> DataFrame:
    """Each valid indicator once, with how often it was given."""
    i = values.select(ioc(F.col(column)).alias("i")).select("i.*").filter("ioc_type is not null")
    return i.groupBy("ioc_type", "normalized_value").agg(F.count(F.lit(1)).alias("n"))


def feed_match(iocs: DataFrame, feed: DataFrame, url: str = "url") -> DataFrame:
    """Indicators in a feed, with or without a slash at the end; the feed is distinct http lines."""
    lines = feed.filter(F.col("value").startswith("http")).select(F.rtrim(F.col("value"), F.lit("/")).alias("_k")).distinct()
    return iocs.withColumn("_k", F.rtrim(F.col(url), F.lit("/"))).join(lines, "_k", "left_semi").drop("_k")


def engine_verdict(stats: Column, kind: Column) -> Column:
    """(verdict, confidence, detections, total_engines) of a map of counts by verdict, as a scanner of many engines reports
    them of a URL, DOMAIN, IPV4, IPV6 or FILE_HASH. Files have other confidences; only a URL can be BENIGN. Confidence has two
    digits, decimal halves rounded up."""
    count = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0))
    bad, odd = count("malicious"), count("suspicious")
    total = F.coalesce(F.aggregate(F.map_values(stats), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))
    share, file = bad / F.greatest(total, F.lit(1)), F.coalesce(kind == "FILE_HASH", F.lit(False))
    fine = F.coalesce(kind == "URL", F.lit(False)) & (count("harmless") > 0)
    verdict = F.when(bad > 0, "MALICIOUS").when(odd > 0, "SUSPICIOUS").when(fine, "BENIGN").otherwise("UNKNOWN")
    by_share = F.when(file, F.least(F.lit(0.98), 0.6 + share * 0.4)).otherwise(F.least(F.lit(0.95), 0.5 + share * 0.5))
    conf = F.when(bad > 0, by_share).when(odd > 0, F.when(file, 0.7).otherwise(0.6)).when(fine, 0.7).otherwise(0.0)
    return F.struct(verdict.alias("verdict"), F.round(F.round(conf, 10), 2).alias("confidence"), bad.alias("detections"), total.alias("total_engines"))


def parsed_scanner(json: Column, kind: Column) -> Column:
    """engine_verdict with categories (of URLs and domains, a list or the values of an object), last_seen and reference of
    an answer; one that is no such answer is UNKNOWN."""
    r = F.from_json(json, "data struct<id: string, attributes: struct<last_analysis_stats: map<string, int>, last_analysis_date: bigint, categories: string>>")["data"]
    attrs = r["attributes"]
    v = engine_verdict(attrs["last_analysis_stats"], kind)
    text = attrs["categories"]
    named = F.when(text.startswith("{"), F.map_values(F.from_json(text, "map<string, string>"))).otherwise(F.from_json(text, "array<string>"))
    held = F.when(kind.isin("URL", "DOMAIN"), named)
    categories = F.coalesce(held, F.array().cast("array<string>"))
    return F.struct(v["verdict"].alias("verdict"), v["confidence"].alias("confidence"), categories.alias("categories"), v["detections"].alias("detections"), v["total_engines"].alias("total_engines"),
                    attrs["last_analysis_date"].alias("last_seen"), r["id"].alias("reference"))


def parsed_abuse(json: Column) -> Column:
    """(verdict, confidence, categories) of an address report: score in percent, category numbers by report, TOR boost."""
    r = F.from_json(json, "abuseConfidenceScore int, isTor boolean, reports array<struct<categories:array<int>>>")
    names = F.create_map(*[x for k, v in ABUSE_CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    ids = F.array_distinct(F.flatten(F.transform(r["reports"], lambda x: x["categories"])))
    score = F.coalesce(r["abuseConfidenceScore"], F.lit(0)) / 100
    conf = F.when(F.coalesce(r["isTor"], F.lit(False)), F.greatest(score, F.least(F.lit(0.9), score + 0.2))).otherwise(score)
    verdict = F.when(score >= 0.75, "MALICIOUS").when(score >= 0.25, "SUSPICIOUS").when(score > 0, "UNKNOWN").otherwise("BENIGN")
    return F.struct(verdict.alias("verdict"), F.round(conf, 6).alias("confidence"), F.array_compact(F.transform(ids, lambda i: F.try_element_at(names, i))).alias("categories"))


def agreement(findings: DataFrame, key: list[str]) -> DataFrame:
    """Counts by verdict; agreement among definitive findings and whether they disagree."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    definite = F.count_if(F.col("verdict").isin(DEFINITIVE))
    most = F.greatest(*[n(v) for v in DEFINITIVE])
    return findings.groupBy(*key).agg(
        F.count(F.lit(1)).alias("findings"), *[n(v).alias(v.lower()) for v in DEFINITIVE], n("UNKNOWN").alias("unknown"),
        F.round(F.coalesce(F.try_divide(most, definite), F.lit(0.0)), 6).alias("agreement"), (F.countDistinct(F.when(F.col("verdict").isin(DEFINITIVE), F.col("verdict"))) > 1).alias("disagreement"),
    )


def weighted_confidence(findings: DataFrame, key: list[str]) -> DataFrame:
    """Mean over indicators of each one's reliability-weighted confidence; only definitive findings count."""
    some = findings.filter(F.col("verdict").isin(DEFINITIVE))
    per = some.groupBy(*key).agg(F.try_divide(F.sum(F.col("confidence") * F.col("reliability")), F.sum("reliability")).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("iocs"), F.round(F.avg("c"), 6).alias("confidence"))


def freshness(findings: DataFrame, key: list[str], queried: str, as_of: Column, each_hour: float = 0.02) -> DataFrame:
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(queried).cast("timestamp"))) / 3_600_000_000
    return findings.groupBy(*key).agg(F.round(F.avg(F.greatest(F.lit(0.0), 1 - hours * each_hour)), 6).alias("freshness"))


def provider_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("provider").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("verdict") == "MALICIOUS").alias("malicious"), F.count_if(F.col("verdict") == "SUSPICIOUS").alias("suspicious"),
        F.count_if(F.col("verdict") == "BENIGN").alias("benign"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def quality_tier(summary: DataFrame) -> DataFrame:
    """Tier of a set of findings from the shares that are definitive and agree: rows with findings, definitive, agreeing."""
    d, a = F.try_divide(F.col("definitive"), F.col("findings")), F.try_divide(F.col("agreeing"), F.col("definitive"))
    tier = F.when((d >= 0.75) & (a >= 0.75), "HIGH").when((d >= 0.5) & (a >= 0.5), "MEDIUM").when(d > 0, "LOW").otherwise("DEGRADED")
    return summary.withColumn("tier", tier)


def cache_status(entries: DataFrame, as_of: Column, stale: Column) -> DataFrame:
    """CACHED before expires_at, STALE in the grace that follows, else EXPIRED."""
    return entries.withColumn("cache_status", F.when(F.col("expires_at") > as_of, "CACHED").when(F.col("expires_at") + stale > as_of, "STALE").otherwise("EXPIRED"))


def health(queries: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("ok"))
    return queries.groupBy("provider").agg(F.count(F.lit(1)).alias("queries"), ok.alias("successes"), F.round(ok / F.count(F.lit(1)), 6).alias("success_rate"))


def evicted(entries: DataFrame, keep: int) -> DataFrame:
    """What a cache of `keep` entries drops: the least recently used."""
    kept = entries.orderBy(F.desc("last_accessed"), "key").limit(keep)
    return entries.join(kept.select("key"), "key", "left_anti")
