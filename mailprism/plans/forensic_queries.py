"""Queries of relay hops, chains, budgets, cases and intelligence on stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forensics, intel
from .registry import query, settled

HOPS = """h as (select user_id, event_id, ts, '10.' || (event_id % 3)::varchar || '.0.' || (floor(value)::bigint % 5)::varchar as ip, event_id % 4 = 0 as private from events)"""


def _hops(t):
    ip = F.concat(F.lit("10."), (F.col("event_id") % 3).cast("string"), F.lit(".0."), (F.col("value").cast("long") % 5).cast("string"))
    return t("events").select("user_id", "event_id", "ts", ip.alias("ip"), (F.col("event_id") % 4 == 0).alias("private"))


FLAGS = f"""{HOPS}, d as (select *, ((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by event_id)))::double / 1e6) as delay_sec,
    count(*) over (partition by user_id, ip order by event_id rows between unbounded preceding and 1 preceding) >= 2 as duplicate_ip from h), f as (select *, coalesce(delay_sec < 0, false) as backwards from d)"""


@query("hop_delays", "WN-02 WN-03 WN-04", f"with {FLAGS} select user_id, event_id, delay_sec, backwards from f")
def hop_delays(t):
    f = forensics.hop_flags(_hops(t), "user_id", "event_id", "ip", "ts")
    return f.select("user_id", "event_id", "delay_sec", "backwards")


@query("dup_preceding", "WN-05", f"with {FLAGS} select user_id, event_id, ip, duplicate_ip from f")
def dup_preceding(t):
    return forensics.hop_flags(_hops(t), "user_id", "event_id", "ip", "ts").select("user_id", "event_id", "ip", "duplicate_ip")


@query("hop_chain", "AG-13 WN-04", f"""with {FLAGS} select user_id, count(*) as hops, count(distinct case when not private then ip end) as public_ips, count(distinct case when private then ip end) as private_ips, min(ts) as first_ts, max(ts) as last_ts,
    round(max(greatest(0.0, delay_sec)), 4) as max_delay, round(avg(case when delay_sec is not null then greatest(0.0, delay_sec) end), 4) as avg_delay, bool_or(backwards) as non_monotonic_timestamps, coalesce(bool_or(delay_sec < -60), false) as ordering_anomaly,
    bool_or(duplicate_ip) as duplicate_source_ip, count(distinct case when not private then ip end) > 8 as unusually_many_hops from f group by 1""")
def hop_chain(t):
    f = forensics.hop_flags(_hops(t), "user_id", "event_id", "ip", "ts")
    c = forensics.hop_chain(f, "user_id", "ip", "ts", F.col("private"))
    return c.withColumns({"max_delay": F.round("max_delay", 4), "avg_delay": F.round("avg_delay", 4)})


@query("first_public_hop", "WN-06", f"with {HOPS} select user_id, arg_min(ip, event_id) as first_public_ip from h where not private group by 1")
def first_public_hop(t):
    return forensics.first_public_hop(_hops(t), "user_id", "event_id", "ip", F.col("private"))


CHAIN = """c as (select conv_id, turn, sha256('{"role": "' || role || '", "turn": "' || turn::varchar || '"}') as content_hash from conversations),
    o as (select *, row_number() over (partition by conv_id order by turn) as k from c where turn >= 0),
    r(conv_id, k, turn, previous_hash, chain_hash) as (select conv_id, k, turn, 'GENESIS', sha256('GENESIS' || content_hash) from o where k = 1
      union all select o.conv_id, o.k, o.turn, r.chain_hash, sha256(r.chain_hash || o.content_hash) from r join o on o.conv_id = r.conv_id and o.k = r.k + 1)"""


def _contents(t):
    js = forensics.canonical_json({"turn": F.col("turn"), "role": F.col("role")})
    return t("conversations").select("conv_id", "turn", F.sha2(js, 256).alias("content_hash"))


@query("chain_build", "WN-09 JS-03 SM-06 SL-07", f"with recursive {CHAIN} select conv_id, turn, previous_hash, chain_hash from r")
def chain_build(t):
    return forensics.built_chain(_contents(t), "conv_id", "turn", "content_hash")


@query("chain_verify", "WN-07", f"""with recursive {CHAIN}, x as (select conv_id, turn, previous_hash, chain_hash, case when conv_id % 10 = 3 and turn = 1 then 'x' else content_hash end as content_hash from r join o using (conv_id, turn)),
    y as (select *, lag(chain_hash, 1, 'GENESIS') over (partition by conv_id order by turn) as b from x)
    select conv_id, turn, previous_hash <> b as broken_link, chain_hash <> sha256(previous_hash || content_hash) as broken_hash from y where previous_hash <> b or chain_hash <> sha256(previous_hash || content_hash)""")
def chain_verify(t):
    c = _contents(t)
    chain = forensics.built_chain(c, "conv_id", "turn", "content_hash").join(c, ["conv_id", "turn"])
    touched = (F.col("conv_id") % 10 == 3) & (F.col("turn") == 1)
    tampered = chain.withColumn("content_hash", F.when(touched, F.lit("x")).otherwise(F.col("content_hash")))
    return forensics.verified_chain(tampered, "conv_id", "turn")


@query("audit_verify", "WN-08", """with c as (select o_orderkey as id, sha256(o_orderkey::varchar) as content_hash, sha256('p' || (o_orderkey - 1)::varchar) as previous_hash from orders),
    x as (select id, case when id = (select min(id) from c) then 'GENESIS' when id % 1000 = 7 then 'bad' else lag(ch) over (order by id) end as previous_hash, content_hash, ch from (select *, sha256(id::varchar || 'c') as ch from c)),
    y as (select *, lag(ch, 1, 'GENESIS') over (order by id) as b from x) select id, previous_hash <> b as broken_link, ch <> sha256(previous_hash || content_hash) as broken_hash from y where previous_hash <> b""")
def audit_verify(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"), F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("c")), 256).alias("chain_hash"))
    before = o.select((F.col("id") + 1).alias("id"), F.col("chain_hash").alias("prev"))  # keys are consecutive
    prev = F.coalesce("prev", F.lit("GENESIS"))
    log = o.join(before, "id", "left").withColumn("previous_hash", F.when((F.col("id") % 1000 == 7) & (prev != "GENESIS"), "bad").otherwise(prev))
    log = settled(log.drop("prev"))
    return forensics.verified_chain(log, None, "id").filter("broken_link")


@query("budget_topn", "WN-12 SL-01 AG-48", "select event_type, user_id, event_id from (select *, row_number() over (partition by event_type order by ts, event_id) as r from events) where r <= 7 order by r, event_type limit 20")
def budget_topn(t):
    return forensics.budget(t("events"), "event_type", [F.col("ts"), F.col("event_id")], 7, 20).select("event_type", "user_id", "event_id")


@query("pagination", "SL-01", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 25 offset 50")
def pagination(t):
    return forensics.page(t("orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 25).select("o_orderkey", "o_orderdate")


@query("latest_per_key", "SL-07", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def latest_per_key(t):
    return forensics.latest(t("events"), "user_id", "event_id", ["event_type"])


@query("topk_factors", "SL-04 SL-05 AR-01", "select l_orderkey, list(l_extendedprice order by l_extendedprice desc)[1:4]::varchar as top4 from lineitem where l_orderkey < 0 group by 1 union all select l_orderkey, array_to_string(list_transform((list(l_extendedprice order by l_extendedprice desc))[1:4], lambda x: x::decimal(18,2)::varchar), ',') from lineitem group by 1")
def topk_factors(t):
    top = F.slice(F.sort_array(F.collect_list(F.col("l_extendedprice").cast("decimal(18,2)")), asc=False), 1, 4)
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(top, lambda x: x.cast("string")), ",").alias("top4"))


@query("rate_limit_window", "SM-05", "select event_id, user_id, count(*) over w as recent, count(*) over w > 2 as limited from events window w as (partition by user_id order by ts range between interval 3600 seconds preceding and current row)")
def rate_limit_window(t):
    return forensics.rate_limited(t("events"), "user_id", "ts", 3600, 2).select("event_id", "user_id", "recent", "limited")


@query("case_counts", "JN-07 JN-16", "select c_custkey, count(o_orderkey) as email_count from customer left join orders on o_custkey = c_custkey group by 1")
def case_counts(t):
    return forensics.case_counts(t("customer").select("c_custkey"), t("orders"), "c_custkey", "o_custkey")


FINDINGS = """f as (select l_partkey as ioc, 'p' || (l_suppkey % 7)::varchar as provider, case (l_orderkey * 7 + l_linenumber) % 4 when 0 then 'UNKNOWN' when 1 then 'BENIGN' when 2 then 'SUSPICIOUS' else 'MALICIOUS' end as verdict,
    l_discount * 10 as confidence, 0.5 + (l_suppkey % 5) / 10.0::double as reliability, l_shipdate as queried from lineitem)"""


def _findings(t):
    return t("lineitem").selectExpr(
        "l_partkey as ioc", "concat('p', l_suppkey % 7) as provider", "case (l_orderkey * 7 + l_linenumber) % 4 when 0 then 'UNKNOWN' when 1 then 'BENIGN' when 2 then 'SUSPICIOUS' else 'MALICIOUS' end as verdict",
        "l_discount * 10 as confidence", "0.5D + (l_suppkey % 5) / 10.0D as reliability", "l_shipdate as queried")


@query("intel_agreement", "AG-17 CO-15", f"""with {FINDINGS}, c as (select ioc, count(*) as findings, count(*) filter (where verdict = 'BENIGN') as benign, count(*) filter (where verdict = 'SUSPICIOUS') as suspicious, count(*) filter (where verdict = 'MALICIOUS') as malicious, count(*) filter (where verdict = 'UNKNOWN') as unknown from f group by 1)
    select *, round(coalesce(greatest(benign, suspicious, malicious) / nullif(benign + suspicious + malicious, 0), 0), 6) as agreement, (benign > 0)::int + (suspicious > 0)::int + (malicious > 0)::int > 1 as disagreement from c""")
def intel_agreement(t):
    return intel.agreement(_findings(t), ["ioc"])


@query("intel_confidence", "AG-18", f"with {FINDINGS}, p as (select ioc, sum(confidence * reliability) / sum(reliability) as c from f where verdict <> 'UNKNOWN' group by 1) select count(*) as iocs, round(avg(c), 6) as confidence from p")
def intel_confidence(t):
    return intel.weighted_confidence(_findings(t), ["ioc"])


@query("intel_freshness", "AG-19", f"with {FINDINGS}, m as (select max(queried) as as_of from f) select ioc, round(avg(greatest(0.0, 1 - (epoch_us(as_of) - epoch_us(queried)) / 3600000000.0 * 0.0002)), 6)::double as freshness from f, m group by 1")
def intel_freshness(t):
    f = _findings(t)
    return intel.freshness(f, ["ioc"], "queried", F.lit(f.agg(F.max("queried")).first()[0]), 0.0002)


@query("provider_summary", "AG-20 WN-15 AG-51", f"with {FINDINGS} select provider, count(*) as findings, count(*) filter (where verdict = 'MALICIOUS') as malicious, count(*) filter (where verdict = 'SUSPICIOUS') as suspicious, count(*) filter (where verdict = 'BENIGN') as benign, round(avg(confidence), 6) as mean_confidence from f group by 1")
def provider_summary(t):
    return intel.provider_summary(_findings(t))


@query("intel_quality", "AG-21", f"""with {FINDINGS}, c as (select provider, count(*) as findings, count(*) filter (where verdict <> 'UNKNOWN') as definitive, count(*) filter (where verdict = 'MALICIOUS') as agreeing from f group by 1)
    select *, case when definitive / findings >= 0.75 and agreeing / definitive >= 0.75 then 'HIGH' when definitive / findings >= 0.5 and agreeing / definitive >= 0.5 then 'MEDIUM' when definitive > 0 then 'LOW' else 'DEGRADED' end as tier from c""")
def intel_quality(t):
    f = _findings(t).groupBy("provider").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("verdict") != "UNKNOWN").alias("definitive"), F.count_if(F.col("verdict") == "MALICIOUS").alias("agreeing"))
    return intel.quality_tier(f)


@query("provider_health", "AG-51", "select 'p' || (l_suppkey % 7)::varchar as provider, count(*) as queries, count(*) filter (where l_returnflag <> 'R') as successes, round(count(*) filter (where l_returnflag <> 'R') / count(*), 6) as success_rate from lineitem group by 1")
def provider_health(t):
    return intel.health(t("lineitem").select(F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string")).alias("provider"), (F.col("l_returnflag") != "R").alias("ok")))


@query("cache_status", "SM-02 SL-09", """with e as (select event_id as key, ts + interval 6 hour as expires_at from events), m as (select max(ts) as as_of from events)
    select cache_status, count(*) as n from (select case when expires_at > as_of then 'CACHED' when expires_at + interval 24 hour > as_of then 'STALE' else 'EXPIRED' end as cache_status from e, m) group by 1""")
def cache_status(t):
    e = t("events")
    as_of = F.lit(e.agg(F.max("ts")).first()[0])
    rows = e.select(F.col("event_id").alias("key"), (F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"))
    return intel.cache_status(rows, as_of, F.expr("interval 24 hours")).groupBy("cache_status").agg(F.count(F.lit(1)).alias("n"))


@query("ioc_normalize", "CO-13 CO-14 HS-01 IP-02", """with v as (select p_partkey as k, unnest(['  8.008.' || p_partkey % 300 || '.8 ', 'Ex' || p_partkey % 9 || '.COM.', 'HTTP://Ex.com/A' || p_partkey % 5, 'a' || p_partkey % 4 || '@B.org', md5(p_partkey::varchar), 'nonsense', '2001:0DB8:0:0:1:0:0:' || p_partkey % 10, '0:0:0:' || p_partkey % 3 || '::', '1::2::3']) as v, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9], 1) as i from part),
    n as (select case i when 1 then 'IPV4' when 2 then 'DOMAIN' when 3 then 'URL' when 4 then 'EMAIL' when 5 then 'FILE_HASH' else 'IPV6' end as ioc_type, case i when 1 then '8.8.' || k % 300 || '.8' when 2 then 'ex' || k % 9 || '.com' when 3 then 'http://ex.com/A' || k % 5
      when 7 then case when k % 10 = 0 then '2001:db8::1:0:0:0' else '2001:db8::1:0:0:' || k % 10 end when 8 then case when k % 3 = 0 then '::' else '0:0:0:' || k % 3 || '::' end else lower(trim(v)) end as normalized_value
      from v where i not in (6, 9) and (i <> 1 or k % 300 <= 255))
    select ioc_type, case when ioc_type = 'IPV6' and normalized_value = '2001:db8::1:0:0:0' then '2001:db8:0:0:1::' else normalized_value end as normalized_value, count(*) as n from n group by 1, 2""")
def ioc_normalize(t):
    k = lambda m: (F.col("p_partkey") % m).cast("string")
    given = [F.concat(F.lit("  8.008."), k(300), F.lit(".8 ")), F.concat(F.lit("Ex"), k(9), F.lit(".COM.")), F.concat(F.lit("HTTP://Ex.com/A"), k(5)), F.concat(F.lit("a"), k(4), F.lit("@B.org")), F.md5(F.col("p_partkey").cast("string")),
             F.lit("nonsense"), F.concat(F.lit("2001:0DB8:0:0:1:0:0:"), k(10)), F.concat(F.lit("0:0:0:"), k(3), F.lit("::")), F.lit("1::2::3")]
    return intel.distinct_iocs(t("part").select(F.explode(F.array(*given)).alias("v")), "v")


@query("scanner_answers", "JS-01 SRC-18", """with p as (select event_id, (props->>'k')::int as k, event_id % 2 as odd, event_id % 5 * 10 as harmless, case event_id % 4 when 0 then 'URL' when 1 then 'DOMAIN' when 2 then 'IPV4' else 'FILE_HASH' end as kind from events),
    c as (select *, k + odd + harmless + 4 as total from p)
    select event_id, case when k > 0 then 'MALICIOUS' when odd > 0 then 'SUSPICIOUS' when kind = 'URL' and harmless > 0 then 'BENIGN' else 'UNKNOWN' end as verdict,
      round((case when k > 0 then case kind when 'FILE_HASH' then least(0.98, 0.6 + k::double / total * 0.4) else least(0.95, 0.5 + k::double / total * 0.5) end when odd > 0 then case kind when 'FILE_HASH' then 0.7 else 0.6 end when kind = 'URL' and harmless > 0 then 0.7 else 0.0 end)::double::decimal(18, 10), 2)::double as confidence,
      case kind when 'URL' then 'phishing,spam' when 'DOMAIN' then 'malware' else '' end as categories, k as detections, total::int as total_engines from c""")
def scanner_answers(t):
    e, n = t("events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["URL", "DOMAIN", "IPV4", "FILE_HASH"])), (n % 4 + 1).cast("int"))
    named = F.when(n % 4 == 0, '["phishing", "spam"]').otherwise('{"vendor": "malware"}')
    js = F.format_string('{"data": {"id": "x", "attributes": {"last_analysis_stats": {"malicious": %s, "suspicious": %d, "harmless": %d, "undetected": 3, "timeout": 1}, "categories": %s}}}', F.get_json_object("props", "$.k"), n % 2, n % 5 * 10, named)
    a = e.select("event_id", intel.parsed_scanner(js, kind).alias("a"))
    return a.select("event_id", "a.verdict", "a.confidence", F.array_join("a.categories", ",").alias("categories"), "a.detections", "a.total_engines")


@query("feed_match", "JN-12 SRC-17", "select count(*) as n from pages where page_id % 3 = 0 or rtrim(url, '/') in (select rtrim(url, '/') from pages where page_id % 3 = 0)")
def feed_match(t):
    feed = t("pages").filter("page_id % 3 = 0").select(F.concat(F.rtrim("url", F.lit("/")), F.lit("/")).alias("value"))
    return intel.feed_match(t("pages").select("page_id", "url"), feed).agg(F.count(F.lit(1)).alias("n"))
