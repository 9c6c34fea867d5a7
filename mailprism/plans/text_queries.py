"""Queries of text, URL, domain and address functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, text
from .registry import query

SHORT, TLDS = (", ".join(f"'{x}'" for x in v) for v in (net.SHORTENERS, net.SUSPICIOUS_TLDS))
#: A deterministic set of URLs of many shapes, from pages.
PROBES = "concat({scheme}, case page_id % 7 when 0 then 'bit.ly' when 1 then '192.168.' || cast(page_id % 250 as varchar) || '.7' when 2 then 'xn--e1awd7f.xyz' when 3 then 'a.b.c.d.example.top' when 4 then 'user@login.example.com:8080' else 'www.example.org' end, '/', case page_id % 3 when 0 then 'login' when 1 then 'a/verify?x=1' else 'index.html#t' end)"


def _probe(t):
    sql = PROBES.replace("{scheme}", "case page_id % 2 when 0 then 'http://' else 'HTTPS://' end").replace("varchar", "string")
    return t("pages").select("page_id", F.expr(sql).alias("u"))


PROBE_SQL = "select page_id, " + PROBES.replace("{scheme}", "case page_id % 2 when 0 then 'http://' else 'HTTPS://' end") + " as u from pages"


@query("url_extract", "ST-04 AR-01 SL-10", r"""
    select page_id, (len(list_distinct(list_transform(regexp_extract_all(html, 'https?://[a-zA-Z0-9._~:/?#\[\]@!$&''()*+,;=%-]+', 0, 'i'),
      lambda u: regexp_replace(u, '[.,;:!?)\]]+$', '')))))::bigint as n_urls from pages""")
def url_extract(t):
    return t("pages").select("page_id", F.size(net.urls_in(F.col("html"))).cast("long").alias("n_urls"))


@query("url_parse", "UR-01 UR-02", rf"""
    with p as ({PROBE_SQL}), a as (select *, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as auth from p)
    select page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme,
    lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[^:\]]*$', '')) as host, regexp_extract(auth, ':([^:@\]]*)$', 1) as port,
    regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) as query,
    contains(auth, '@') as has_userinfo, lower(regexp_extract(u, '^[A-Za-z]+://[^/?#]*', 0)) || substr(u, length(regexp_extract(u, '^[A-Za-z]+://[^/?#]*', 0)) + 1) as normalized from a""")
def url_parse(t):
    p = _probe(t).withColumn("p", net.url_parts(F.col("u")))
    return p.select("page_id", "p.*", net.normalized_url(F.col("u")).alias("normalized"))


@query("url_flags", "UR-03 JN-11", rf"""
    with p as ({PROBE_SQL}), a as (select page_id, lower(regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':[^:\]]*$', '')) as h,
      regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from p),
    f as (select page_id, regexp_full_match(h, '[0-9]+(\.[0-9]+){{3}}') as is_ip_url, h in ({SHORT}) as is_shortener,
      (contains(h, '.') and string_split(h, '.')[-1] in ({TLDS})) as suspicious_tld, len(string_split(h, '.')) - 1 > 3 as excessive_subdomains,
      starts_with(h, 'xn--') as has_punycode, regexp_matches(path, '/(login|signin|auth|verify|secure|update|confirm|account|password|credential|banking)', 'i') as suspicious_path from a)
    select *, round(least(1.0, is_ip_url::int * 0.3 + is_shortener::int * 0.2 + suspicious_tld::int * 0.15 + excessive_subdomains::int * 0.15
      + has_punycode::int * 0.2 + suspicious_path::int * 0.15)::double, 6) as risk_score from f""")
def url_flags(t):
    return _probe(t).select("page_id", net.url_analysis(F.col("u")).alias("a")).select("page_id", "a.*")


@query("html_text", "ST-03 ST-05", r"""
    select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|head)[^>]*>.*?</(script|style|head)>', ' ', 'gis'),
      '<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) as body, len(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1, 'i'))::bigint as n_links from pages""")
def html_text(t):
    return t("pages").select("page_id", text.html_text(F.col("html")).alias("body"), F.size(text.html_links(F.col("html"))).cast("long").alias("n_links"))


@query("html_parsed", "ST-03 ST-06 ST-02")
def html_parsed(t):
    p = t("pages").select("page_id", text.parsed_html("html").alias("p"))
    return p.select("page_id", text.normalized_body(F.col("p.text")).alias("body"), F.size("p.links").alias("n_links"))


BRANDS_SQL = ", ".join(f"('{b}')" for b in net.BRANDS)


@query("domain_lookalike", "JN-08 ST-16 ST-17 CO-01", rf"""
    with d as (select distinct case p_partkey % 5 when 0 then 'paypa' || chr((97 + p_partkey % 26)::int) || '.com' when 1 then 'www.g00gle.com' when 2 then 'mail.ch' || chr((97 + p_partkey % 7)::int) || 'se.com'
      when 3 then 'fedex.co' else 'shop' || (p_partkey % 40)::varchar || '.net' end as domain from part),
    m as (select domain, array_to_string(string_split(domain, '.')[-2:], '.') as m from d), b(brand) as (values {BRANDS_SQL}),
    x as (select domain, brand, levenshtein(m, brand) as distance, greatest(length(m), length(brand)) as l from m, b)
    select domain, brand, distance::int as distance, round((1 - distance / l) * 100, 1) as similarity_pct from x where distance between 1 and 3""")
def domain_lookalike(t):
    d = t("part").select(F.expr("""case p_partkey % 5 when 0 then 'paypa' || char(97 + p_partkey % 26) || '.com' when 1 then 'www.g00gle.com'
        when 2 then 'mail.ch' || char(97 + p_partkey % 7) || 'se.com' when 3 then 'fedex.co' else 'shop' || cast(p_partkey % 40 as string) || '.net' end""").alias("domain"))
    return net.lookalikes(d.distinct(), "domain")


HOST_SQL = "select distinct lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host from pages"


def _hosts(t):
    return t("pages").select(net.url_host(F.col("url")).alias("host")).distinct()


@query("domain_features", "ST-18 ST-19 ST-20", rf"""
    with h as ({HOST_SQL}), l as (select host, string_split(host, '.') as p from h)
    select host, length(host)::bigint as len, len(p)::bigint as labels, p[-1] as tld, array_to_string(p[-2:], '.') as org,
    len(regexp_extract_all(host, '[0-9]'))::bigint as digits, (len(string_split(host, '-')) - 1)::bigint as hyphens, contains(host, 'xn--') as punycode, p[-1] in ({TLDS}) as bad_tld from l""")
def domain_features(t):
    h = F.col("host")
    return _hosts(t).select(
        "host", F.length(h).cast("long").alias("len"), F.size(F.split(h, r"\.")).cast("long").alias("labels"), net.tld(h).alias("tld"),
        net.organizational_domain(net.address_domain(F.concat(F.lit("Some One <x@"), h, F.lit(">")))).alias("org"),
        F.regexp_count(h, F.lit("[0-9]")).cast("long").alias("digits"), F.regexp_count(h, F.lit("-")).cast("long").alias("hyphens"),
        h.contains("xn--").alias("punycode"), net.tld(h).isin(net.SUSPICIOUS_TLDS).alias("bad_tld"),
    )


@query("domain_entropy", "ST-15", rf"""
    with h as ({HOST_SQL}), c as (select host, unnest(string_split(host, '')) as ch from h), n as (select host, ch, count(*) as k from c group by 1, 2),
    s as (select host, sum(k) as t from n group by 1), c2 as (select host, ch, k from n where ch not in ('.', '-')), s2 as (select host, sum(k) as t from c2 group by 1)
    select a.host, a.e as entropy, b.e as entropy_letters from
      (select host, round(-sum(k / t * log2(k / t)), 6) as e from n join s using (host) group by 1) a join
      (select host, round(-sum(k / t * log2(k / t)), 6) as e from c2 join s2 using (host) group by 1) b using (host)""")
def domain_entropy(t):
    return _hosts(t).select("host", F.round(text.entropy(F.col("host")), 6).alias("entropy"), F.round(text.domain_entropy(F.col("host")), 6).alias("entropy_letters"))


@query("ip_extract_classify", "IP-01 IP-03 IP-04 FP-13", r"""
    with e as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) as ip from documents),
    n as (select doc_id, ip, list_transform(string_split(ip, '.'), lambda x: x::int) as p from e),
    v as (select doc_id, ip, p[1] <= 255 and p[2] <= 255 and p[3] <= 255 and p[4] <= 255 as valid, ((p[1]::bigint * 256 + p[2]) * 256 + p[3]) * 256 + p[4] as x, p from n)
    select doc_id, ip, valid, case when valid then x end as number, case when valid then array_to_string(p, '.') end as normalized,
    valid and (p[1] in (0, 10, 127) or p[1] >= 240 or (p[1] = 100 and p[2] between 64 and 127) or (p[1] = 169 and p[2] = 254) or (p[1] = 172 and p[2] between 16 and 31)
      or (p[1] = 192 and p[2] = 168) or (p[1] = 192 and p[2] = 0 and p[3] in (0, 2)) or (p[1] = 198 and p[2] in (18, 19)) or (p[1] = 198 and p[2] = 51 and p[3] = 100)
      or (p[1] = 203 and p[2] = 0 and p[3] = 113)) as is_private from v""")
def ip_extract_classify(t):
    ips = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(net.IPV4), F.lit(0))).alias("ip"))
    n = net.ipv4_number(F.col("ip"))
    return ips.select("doc_id", "ip", n.isNotNull().alias("valid"), n.alias("number"), net.normalized_ipv4(F.col("ip")).alias("normalized"),
                      F.coalesce(net.is_private(net.normalized_ipv4(F.col("ip"))), F.lit(False)).alias("is_private"))


@query("cidr_join", "JN-09 SRC-15", """
    with n as (select r_regionkey as id, r_regionkey::bigint * 1000000 as lo, r_regionkey::bigint * 1000000 + 700000 as hi from region)
    select o_orderkey, id from orders join n on o_orderkey * 97 between lo and hi""")
def cidr_join(t):
    lo = F.col("r_regionkey").cast("long") * 1_000_000
    nets = t("region").select(F.col("r_regionkey").alias("id"), lo.alias("lo"), (lo + 700_000).alias("hi"))
    rows = t("orders").select("o_orderkey", (F.col("o_orderkey") * 97).alias("ip"))
    return net.cidr_join(rows, "ip", nets).select("o_orderkey", "id")


def _bec_sql() -> str:
    one = lambda terms: " + ".join(f"len(regexp_extract_all(x, '\\b{w}\\b', 0, 'i'))" for w in terms)
    cols = ", ".join(f"({one(terms)})::double as {name}" for name, terms in text.LEXICONS.items())
    return f"select page_id, {cols} from (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') || ' Urgent: verify your account password, wire transfer invoice' as x from pages)"


@query("bec_keyword_counts", "ST-11 ST-12", _bec_sql())
def bec_keyword_counts(t):
    x = F.concat(F.regexp_replace("html", "<[^>]*>", " "), F.lit(" Urgent: verify your account password, wire transfer invoice"))
    p = t("pages").select("page_id", x.alias("x"))
    return p.select("page_id", *[text.lexicon_count(F.col("x"), terms).alias(n) for n, terms in text.LEXICONS.items()])


@query("content_structure", "ST-13 ST-14", r"""
    select doc_id, round(len(regexp_extract_all(text, '[0-9]')) / length(text), 4) as digit_ratio, round(len(regexp_extract_all(text, '[A-Z]')) / length(text), 4) as upper_ascii_ratio,
    round(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) / length(text), 4) as punctuation_ratio, len(regexp_extract_all(text, '!'))::double as exclamations,
    len(regexp_extract_all(text, '\?'))::double as questions, len(regexp_extract_all(text, '[$€£¥₹]'))::double as currency, regexp_matches(text, '(\r?\n[ \t\r\n\f]*){5,}') as blank_anomaly from documents where text <> ''""")
def content_structure(t):
    c = F.col("text")
    return t("documents").filter("text <> ''").select(
        "doc_id", F.round(text.share_of(c, "[0-9]"), 4).alias("digit_ratio"), F.round(text.share_of(c, "[A-Z]"), 4).alias("upper_ascii_ratio"),
        F.round(text.share_of(c, r"[!-/:-@\[-`{-~]"), 4).alias("punctuation_ratio"), text.count_of(c, "!").alias("exclamations"),
        text.count_of(c, r"\?").alias("questions"), text.count_of(c, "[$€£¥₹]").alias("currency"), c.rlike(r"(\r?\n[ \t\r\n\f]*){5,}").alias("blank_anomaly"),
    )


@query("repeated_chars", "ST-14", """select doc_id, coalesce(list_bool_or(list_transform(list_distinct(string_split(text, '')), lambda c: contains(text, repeat(c, 4)) and c not in (chr(10), chr(13), chr(133), chr(8232), chr(8233)))), false) as repeated from documents""")
def repeated_chars(t):
    return t("documents").select("doc_id", text.repeated_character(F.col("text")).alias("repeated"))


@query("pii_masking", "ST-08 ST-09 ST-25", r"""
    with m as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '(https?://[^ \t\r\n<>]+|www\.[^ \t\r\n<>]+)', '[URL]', 'gi'),
      '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[$€£¥][ ]?[0-9][0-9,]*(\.[0-9]+)?', '[MONEY]', 'g'),
      '\+?[0-9]{1,3}[-. ][0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}', '[PHONE]', 'g'), '[ \t\r\n\f]+', ' ', 'g')) as masked from documents)
    select doc_id, '[SUBJECT] [EMPTY] [BODY] ' || coalesce(nullif(trim(masked), ''), '[EMPTY]') as masked from m""")
def pii_masking(t):
    return t("documents").select("doc_id", text.formatted(F.lit(" "), text.masked(F.col("text"))).alias("masked"))


@query("attachment_flags", "ST-24 CO-02 HS-01", r"""
    with f as (select p_partkey as k, case p_partkey % 6 when 0 then 'invoice.pdf.exe' when 1 then 'photo.JPG' when 2 then 'archive.tar.gz' when 3 then 'run.js' when 4 then 'noext' else 'a.zip.scr' end as fn,
      case p_partkey % 4 when 0 then 'application/x-msdownload' when 1 then 'Application/JavaScript; x=1' else 'application/pdf' end as ct, p_size * 400000::bigint as size from part),
    e as (select *, nullif(lower(regexp_extract(fn, '[^.]\.([^.]*)$', 1)), '') as ext, string_split(lower(fn), '.') as p from f),
    g as (select k, ext as extension, coalesce(ext in ('exe', 'scr', 'js'), false) as is_dangerous_extension, coalesce(len(p) >= 3 and p[-1] in ('exe', 'scr') and p[-2] in ('pdf', 'zip'), false) as has_double_extension,
      coalesce(ext is not null and ((ct = 'application/x-msdownload' and ext not in ('exe', 'dll', 'scr')) or (lower(split_part(ct, ';', 1)) = 'application/javascript' and ext <> 'js')), false) as mime_mismatch,
      coalesce(ext in ('gz', 'zip'), false) as is_archive, size > 10485760 as is_large from e)
    select *, round(least(1.0, is_dangerous_extension::int * 0.5 + has_double_extension::int * 0.4 + mime_mismatch::int * 0.2 + is_archive::int * 0.1 + is_large::int * 0.05)::double, 6) as risk_score from g""")
def attachment_flags(t):
    f = t("part").selectExpr("p_partkey as k", """case p_partkey % 6 when 0 then 'invoice.pdf.exe' when 1 then 'photo.JPG' when 2 then 'archive.tar.gz'
        when 3 then 'run.js' when 4 then 'noext' else 'a.zip.scr' end as fn""", """case p_partkey % 4 when 0 then 'application/x-msdownload'
        when 1 then 'Application/JavaScript; x=1' else 'application/pdf' end as ct""", "p_size * 400000L as size")  # fmt: skip
    return f.select("k", net.attachment_analysis(F.col("fn"), F.col("ct"), F.col("size")).alias("a")).select("k", "a.*")


@query("iso_times", "DT-02", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end as at_iso, strftime(ts + to_microseconds(event_id % 2 * 40), '%Y-%m-%dT%H:%M:%S')
    || case when epoch_us(ts + to_microseconds(event_id % 2 * 40)) % 1000000 = 0 then '' else strftime(ts + to_microseconds(event_id % 2 * 40), '.%f') end as later_iso from events""")
def iso_times(t):
    later = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 2 * 40 / 1_000_000).cast("decimal(18,6)"))
    return t("events").select("event_id", text.iso(F.col("ts")).alias("at_iso"), text.iso(later).alias("later_iso"))


@query("canonical_urls", "UR-02 ST-18 CO-13", r"""
    with p as (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host, regexp_replace(url, '^[A-Za-z]+://[^/?#]*', '') as rest from pages),
    h as (select *, case page_id % 3 when 0 then 'xn--bcher-kva.' when 1 then 'xn--mnchen-3ya.' else 'www.' end || host as whole from p where host <> '' and not contains(host, ':') and not contains(host, '@'))
    select page_id, case when page_id % 11 > 0 then 'http://' || whole || case when page_id % 2 = 0 then ':8080' else '' end || rest end as canonical, case when page_id % 11 > 0 then whole end as host from h""")
def canonical_urls(t):
    host, rest = F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1), F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "")
    k = F.col("page_id")
    odd = F.concat(F.when(k % 11 == 0, "ftp").otherwise("HTTP"), F.lit("://User:x@"), F.when(k % 3 == 0, "BÜCHER.").when(k % 3 == 1, "münchen.").otherwise("WWW."), F.upper(host), F.when(k % 2 == 0, ":08080").otherwise(":0"), rest)
    p = t("pages").filter((host != "") & ~host.contains(":") & ~host.contains("@"))
    return p.select(k, net.canonical_url(odd).alias("u")).select("page_id", F.col("u.url").alias("canonical"), "u.host")
