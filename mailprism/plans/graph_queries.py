"""Queries of the entity graph on stand-ins: orders as emails, lineitems as links, events as sightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, settled

@query("shared_infrastructure", "AG-12 GR-09 JN-01 JN-04", """
    select l_partkey, l_returnflag, count(distinct l_orderkey) as email_count from lineitem group by 1, 2 having count(distinct l_orderkey) >= 16""")
def shared_infrastructure(t):
    return graph.shared_infrastructure(t("lineitem"), "l_orderkey", ["l_partkey", "l_returnflag"], least=16)


@query("shared_emails", "AG-12 GR-08", """
    with s as (select l_partkey, l_returnflag from lineitem group by 1, 2 having count(distinct l_orderkey) >= 18)
    select distinct l_partkey, l_returnflag, l_orderkey from lineitem join s using (l_partkey, l_returnflag)""")
def shared_emails(t):
    links = t("lineitem").select("l_partkey", "l_returnflag", "l_orderkey")
    return graph.emails_of(links, graph.shared_infrastructure(links, "l_orderkey", ["l_partkey", "l_returnflag"], 18), ["l_partkey", "l_returnflag"])


@query("two_hop_counts", "JN-02 JN-03 JN-04 JN-16", """
    select n_name, count(distinct o_orderkey) as emails, count(distinct l_partkey) as files from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def two_hop_counts(t):
    path = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    path = path.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return path.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("emails"), F.countDistinct("l_partkey").alias("files"))


TIMELINE = "select event_type, user_id % 20 as ioc, min(ts) as first_seen, max(ts) as last_seen, count(*) as observations, count(distinct user_id) as entities, round(epoch_us(max(ts))::double / 86400000000 - epoch_us(min(ts))::double / 86400000000, 6) as duration_days from events group by 1, 2"


def _timeline(t):
    e = t("events").withColumn("ioc", F.col("user_id") % 20)
    return graph.ioc_timeline(e, ["event_type", "ioc"], "user_id", "ts")


@query("ioc_timeline", "GR-12 DT-03 SM-01 GR-01", TIMELINE)
def ioc_timeline(t):
    return _timeline(t)


@query("trending", "GR-13 SL-02 FP-02", f"""
    with t as ({TIMELINE}), m as (select max(ts) as as_of from events)
    select t.* from t, m where last_seen >= as_of - interval 1 day order by last_seen desc, observations desc, event_type, ioc limit 10""")
def trending(t):
    as_of = F.lit(t("events").agg(F.max("ts")).first()[0])
    return graph.trending(_timeline(t), as_of, 1, 10, ["event_type", "ioc"])


@query("lifetime_stats", "GR-15 AG-14 AG-15", f"""
    with t as ({TIMELINE}), m as (select max(ts) as as_of from events), s as (select list_sort(list(duration_days)) l, count(*) n from t)
    select count(*) as n, round(min(duration_days), 4) as min_days, round(max(duration_days), 4) as max_days, round(avg(duration_days), 4) as mean_days,
    round(quantile_cont(duration_days, 0.5), 4) as median_days, round(any_value(l[least(floor(s.n * 0.9), s.n - 1)::int + 1]), 4) as p90_days,
    round(any_value(l[least(floor(s.n * 0.95), s.n - 1)::int + 1]), 4) as p95_days, count(*) filter (where last_seen >= as_of - interval 30 day) as active,
    round(100 * count(*) filter (where last_seen >= as_of - interval 30 day) / count(*), 4) as active_pct from t, m, s""")
def lifetime_stats(t):
    return graph.lifetime_stats(_timeline(t), F.lit(t("events").agg(F.max("ts")).first()[0]))


@query("temporal_correlation", "GR-14 SO-04 JN-15", """
    with s as (select event_type || '-' || (user_id % 8)::varchar as ioc, date_trunc('day', ts) as day, ts from events), f as (select ioc, min(ts) as first, count(distinct day) as size from s group by 1),
    p as (select distinct ioc, day from s), m as (select x.ioc as a, y.ioc as b, count(*) as common from p x join p y on x.day = y.day and x.ioc < y.ioc group by 1, 2),
    j as (select a, b, common, common / (fa.size + fb.size - common) as jac, abs(epoch_us(fa.first) - epoch_us(fb.first)) / 3600000000.0 as hours from m join f fa on fa.ioc = a join f fb on fb.ioc = b),
    k as (select a, b, common, 0.7 * jac + 0.3 * greatest(0.0, 1 - hours / 24.0) as score from j)
    select a, b, common, round(score::double, 6) as score, case when score > 0.7 then 'high' when score > 0.3 then 'medium' else 'low' end as level from k""")
def temporal_correlation(t):
    s = t("events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 8).cast("string")).alias("ioc"), F.date_trunc("day", "ts").alias("day"), "ts")
    return graph.temporal_correlation(s, "ioc", "day", "ts")


def _campaign_links(t):
    e = t("events")
    return e.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))


CAMPAIGN = """l as (select distinct user_id, event_type, date_trunc('hour', ts) as hour from events),
    p as (select x.user_id as a, y.user_id as b, count(*) as shared from l x join l y on x.event_type = y.event_type and x.hour = y.hour and x.user_id < y.user_id group by 1, 2 having count(*) >= 5)"""


@query("campaign_star", "GR-16", f"""
    with {CAMPAIGN}, b as (select a, b from p union all select b, a from p) select a as seed, count(distinct b) + 1 as emails from b group by 1 having count(distinct b) + 1 >= 3""")
def campaign_star(t):
    return graph.campaign_seeds(_campaign_links(t), "user_id", ["event_type", "hour"], 5, 3, settled)


@query("campaign_component", "GR-16", f"""
    with recursive {CAMPAIGN}, b as (select a, b from p union all select b, a from p),
    r(node, seen) as (select distinct a, a from b union select r.node, b.b from r join b on r.seen = b.a)
    select node, min(seen) as component from r group by 1""")
def campaign_component(t):
    return graph.campaign_components(_campaign_links(t), "user_id", ["event_type", "hour"], 5, settled)


@query("campaign_scores", "GR-16 AG-52 AG-53 SL-03 CO-08", """
    with e as (select user_id % 25 as campaign, event_type, user_id, ts from events),
    n as (select campaign, event_type, count(*) as n from e group by 1, 2), r as (select campaign, avg(1 - least(1.0, n / 100)) as rarity from n group by 1),
    c as (select campaign, count(distinct user_id) as emails, count(distinct event_type) as iocs, greatest(0.0, 1 - (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 / 40) as tc from e group by 1)
    select campaign, emails, iocs, round((least(1.0, 0.1 * emails + 0.05 * iocs) * (0.5 + 0.3 * tc + 0.2 * rarity))::double, 6) as score from c join r using (campaign) order by score desc, campaign limit 20""")
def campaign_scores(t):
    e = t("events").withColumn("campaign", F.col("user_id") % 25)
    r = e.groupBy("campaign", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("campaign").agg(graph.rarity(F.col("n")).alias("rarity"))
    c = e.groupBy("campaign").agg(F.countDistinct("user_id").alias("emails"), F.countDistinct("event_type").alias("iocs"),
                                  graph.temporal_concentration(F.min("ts"), F.max("ts"), 40.0).alias("tc"))
    score = F.round(graph.campaign_score(F.col("emails"), F.col("iocs"), F.col("tc"), F.col("rarity")), 6)
    return c.join(r, "campaign").select("campaign", "emails", "iocs", score.alias("score")).orderBy(F.desc("score"), "campaign").limit(20)


LINKS = """select 'c' || c_custkey::varchar as source, 'n' || c_nationkey::varchar as target from customer union select 'n' || n_nationkey::varchar, 'r' || n_regionkey::varchar from nation
    union select 'o' || o_orderkey::varchar, 'c' || o_custkey::varchar from orders"""


def _links(t):
    e = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("source"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("target"))
    return e(t("customer"), "c", "c_custkey", "n", "c_nationkey").unionByName(e(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).unionByName(e(t("orders"), "o", "o_orderkey", "c", "o_custkey"))


@query("bfs_levels", "GR-10", f"""
    with recursive l as ({LINKS}), r(node, level) as (select 'o' || o_orderkey::varchar, 0 from orders
    union select l.target, level + 1 from r join l on r.node = l.source where level < 3) select node, min(level)::int as level from r group by 1""")
def bfs_levels(t):
    start = t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.bfs_levels(_links(t), start, 3, settled)


@query("bfs_fan_out", "GR-10 SL-08 GR-21", f"""
    with recursive l0 as ({LINKS}), l1 as (select source, target from l0 union select target, source from l0), l as (select source, target from (select *, row_number() over (partition by source order by target) as k from l1) where k <= 10),
    r(node, level) as (select 'r0', 0 union select l.target, level + 1 from r join l on r.node = l.source where level < 3) select node, min(level)::int as level from r group by 1""")
def bfs_fan_out(t):
    start = t("region").sparkSession.range(1).select(F.lit("r0").alias("node"))
    return graph.bfs_levels(_links(t), start, 3, settled, fan_out=10, directed=False)


@query("shortest_path", "GR-11", f"""
    with recursive l as ({LINKS}), r(node, level) as (select 'o' || o_orderkey::varchar, 0 from orders
    union select l.target, level + 1 from r join l on r.node = l.source where level < 5) select node, min(level)::int as level from r where node like 'r%' group by 1""")
def shortest_path(t):
    start = t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    goal = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.shortest_path_length(_links(t), start, goal, 5, settled)


@query("degree_map", "GR-21", f"""
    with l as ({LINKS}), d as (select source as node from l union all select target from l) select node, count(*) as degree from d group by 1""")
def degree_map(t):
    return graph.degrees(_links(t).distinct())


@query("hunt_all_iocs", "GR-20 SO-02", """
    select l_orderkey, count(distinct l_suppkey) as matched from lineitem where l_suppkey in (1, 2, 3) group by 1 having count(distinct l_suppkey) = 2 or count(distinct l_suppkey) = 3""")
def hunt_all_iocs(t):
    links = t("lineitem").select("l_orderkey", "l_suppkey")
    two = graph.hunt(links, "l_orderkey", "l_suppkey", [1, 2, 3], require=False)
    return two.filter("matched >= 2")


@query("hunt_without", "GR-20 JN-05 FP-04 FP-03 FP-05", """
    select o_orderkey, o_orderpriority from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
    and contains(lower(o_orderpriority), 'ur') and o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31'""")
def hunt_without(t):
    o = t("orders").filter(F.lower("o_orderpriority").contains("ur") & F.col("o_orderdate").between("1995-01-01", "1996-12-31"))
    links = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return graph.with_and_without(o, links, "o_orderkey", False).select("o_orderkey", "o_orderpriority")


@query("hunt_with", "GR-20 JN-06 FP-01", """
    select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 48) and o_orderstatus = 'F'""")
def hunt_with(t):
    links = t("lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return graph.with_and_without(t("orders").filter("o_orderstatus = 'F'"), links, "o_orderkey", True).select("o_orderkey", "o_custkey")


@query("reputation", "AG-16 GR-17", """
    with f as (select l_partkey, l_discount as confidence, greatest(0.0, least(1.0, s_acctbal / 10000)) as reliability from lineitem join supplier on l_suppkey = s_suppkey)
    select l_partkey, round(case when sum(reliability * confidence) <> 0 then sum(reliability * confidence * confidence) / sum(reliability * confidence) end, 6) as reputation, count(*) as reports,
    case when count(*) filter (where confidence >= 0.5) > 3 then 'high' when count(*) filter (where confidence >= 0.5) > 0 then 'medium' else 'low' end as correlation from f group by 1""")
def reputation(t):
    f = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_partkey", F.col("l_discount").alias("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s_acctbal") / 10000)).alias("reliability"))
    return graph.reputation(f, "l_partkey")


def _mail(t):
    d = t("pages").selectExpr(
        "page_id as email_id", "timestamp_seconds(page_id * 3600) as seen_at", "concat('u', page_id % 40, '@host', page_id % 9, '.example') as sender",
        "page_id % 12 as case_id", "array(concat('10.0.', page_id % 5, '.', page_id % 50)) as ips", "array(url) as urls",
        "array(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1))) as domains", "cast(array() as array<string>) as addresses",
        "array(concat('r', page_id % 7, '@corp.example')) as recipients", "array(struct('a.pdf' as filename, sha2(cast(page_id % 30 as string), 256) as sha256)) as attachments")
    return graph.mail_graph(d)


@query("mail_graph_stats", "GR-02 GR-03 GR-04 GR-19 AG-11", """
    with p as (select page_id as e, page_id % 40 || '-' || page_id % 9 as s, page_id % 9 as sd, page_id % 12 as c, page_id % 5 || '.' || page_id % 50 as ip, url,
      lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) as h, page_id % 7 as r, page_id % 30 as f from pages)
    select 'edge' as kind, v as value, n from (values ('SENT_FROM', (select count(distinct e) from p)), ('USES_DOMAIN', (select count(distinct (s, sd)) from p)), ('PART_OF_CASE', (select count(distinct (e, c)) from p)),
      ('RECEIVED_FROM_IP', (select count(distinct (e, ip)) from p)), ('CONTAINS_URL', (select count(distinct (e, url)) from p)), ('CONTAINS_DOMAIN', (select count(distinct (e, h)) from p)),
      ('SENT_TO', (select count(distinct (e, r)) from p)), ('BELONGS_TO_DOMAIN', (select count(distinct (url, h)) from p)), ('HAS_ATTACHMENT', (select count(*) from p)), ('HAS_FILE_HASH', (select count(*) from p))) x(v, n)
    union all select 'node', v, n from (values ('EMAIL', (select count(*) from p)), ('SENDER', (select count(distinct s) from p)), ('CASE', (select count(distinct c) from p)), ('IPV4', (select count(distinct ip) from p)),
      ('URL', (select count(distinct url) from p)), ('DOMAIN', (select count(distinct h) from p) + (select count(distinct sd) from p)), ('EMAIL_ADDRESS', (select count(distinct r) from p)),
      ('ATTACHMENT', (select count(*) from p)), ('FILE_HASH', (select count(distinct f) from p))) y(v, n)""")
def mail_graph_stats(t):
    return graph.graph_stats(*_mail(t))


@query("mail_graph_by_domain", "GR-08 SO-03 JN-02", """
    select sha256('EMAIL|' || page_id) as source from pages where page_id % 9 = 3 or lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) = 'host3.example'""")
def mail_graph_by_domain(t):
    nodes, edges = _mail(t)
    return graph.emails_by(edges, nodes, "DOMAIN", "host3.example")


@query("mail_graph_export", "GR-19 SNK-07 FP-14", """
    with p as (select page_id::varchar as e, 'u' || page_id % 40 || '@host' || page_id % 9 || '.example' as s, 'host' || page_id % 9 || '.example' as sd, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) as h from pages),
    n as (select 'EMAIL' as k, e as v from p union select 'SENDER', s from p union select 'DOMAIN', sd from p union select 'DOMAIN', h from p where h <> ''),
    l as (select distinct 'EMAIL|' || e as a, 'SENDER|' || s as b, 'SENT_FROM' as r from p union select 'SENDER|' || s, 'DOMAIN|' || sd, 'USES_DOMAIN' from p union select 'EMAIL|' || e, 'DOMAIN|' || h, 'CONTAINS_DOMAIN' from p where h <> '')
    select '{"group":"nodes","data":{"id":"' || sha256(k || '|' || v) || '","type":"' || k || '","label":"' || v || '"}}' as element from n
    union all select '{"group":"edges","data":{"source":"' || sha256(a) || '","target":"' || sha256(b) || '","label":"' || r || '"}}' from l""")
def mail_graph_export(t):
    nodes, edges = _mail(t)
    return graph.cytoscape(*graph.visible_subgraph(nodes, edges, ["EMAIL", "SENDER", "DOMAIN"]))
