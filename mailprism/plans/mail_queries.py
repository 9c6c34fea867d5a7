"""Queries of features, scoring, fusion, streams and models on stand-ins, and of raw mail fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, forensics, ml, scoring
from ..sources import mime
from ..streaming import state
from .registry import query, settled

# ---- risk rows from documents

RISK = """r as (select doc_id, ((doc_id * 37) % 101) / 100.0::double as a, ((doc_id * 53) % 97) / 97.0::double as b, case doc_id % 5 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'SOFTFAIL' when 3 then 'NONE' end as spf,
    case doc_id % 4 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'PERMERROR' end as dkim, case doc_id % 3 when 0 then 'PASS' when 1 then 'FAIL' end as dmarc, n_chars, text, 'paypal' || doc_id % 3 || case doc_id % 9 when 0 then '.top' else '.example' end as sd from documents),
    p as (select *, a * (1 - b) as p_legit, (1 - a) * (1 - b) as p_spam, b as p_phish, (1 - a) * b as q_legit, a * b as q_spam, 1 - b as q_phish from r),
    t as (select *, least(1.0, 0.5 * (abs(p_legit - q_legit) + abs(p_spam - q_spam) + abs(p_phish - q_phish)))::double as tvd from p)"""


def _risk(t):
    r = t("documents").selectExpr(
        "doc_id", "((doc_id * 37) % 101) / 100.0D as a", "((doc_id * 53) % 97) / 97.0D as b", "case doc_id % 5 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'SOFTFAIL' when 3 then 'NONE' end as spf",
        "case doc_id % 4 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'PERMERROR' end as dkim", "case doc_id % 3 when 0 then 'PASS' when 1 then 'FAIL' end as dmarc", "n_chars", "text")
    r = r.selectExpr("*", "a * (1 - b) as p_legit", "(1 - a) * (1 - b) as p_spam", "b as p_phish", "(1 - a) * b as q_legit", "a * b as q_spam", "1 - b as q_phish")
    return r.withColumn("tvd", scoring.tvd(P(), Q()))


def P():
    return [F.col(f"p_{c}") for c in ("legit", "spam", "phish")]


def Q():
    return [F.col(f"q_{c}") for c in ("legit", "spam", "phish")]


POINTS = """c as (select doc_id, tvd, (case when p_phish >= 0.7 then 20 + 15 * (p_phish - 0.7) / 0.3 when p_phish >= 0.4 then 8 + 12 * (p_phish - 0.4) / 0.3 else 0 end + case when p_spam >= 0.5 then 10 * p_spam else 0 end
      + case when p_legit >= 0.8 and p_phish < 0.2 then -10 * (p_legit - 0.8) / 0.2 else 0 end + case when tvd >= 0.35 then 5 * tvd else 0 end)::double as m,
    (case when dmarc = 'FAIL' then 12 else 0 end + case when spf in ('FAIL', 'SOFTFAIL') then 8 else 0 end + case when dkim in ('FAIL', 'PERMERROR') then 8 else 0 end + case when spf = 'PASS' and dkim = 'PASS' and dmarc = 'PASS' and p_phish < 0.5 then -5 else 0 end)::double as au,
    (case when n_chars % 11 = 0 then 8 else 0 end + case when n_chars % 7 = 0 then 4 else 0 end + case when n_chars % 5 = 0 then 5 else 0 end + case when n_chars % 13 > 5 then 3 else 0 end)::double as u,
    (case when n_chars % 17 = 0 then 5 else 0 end + case when n_chars % 12 > 8 then 4 else 0 end + case when n_chars % 9 = 0 then 3 else 0 end)::double as ir,
    (case when n_chars % 19 = 0 then 10 else 0 end + case when n_chars % 23 = 0 then 10 else 0 end + case when n_chars % 4 = 0 then 4 else 0 end)::double as attach,
    (case when doc_id % 4 = 1 then 8 else 0 end + case when doc_id % 5 = 0 then 6 else 0 end + case when doc_id % 7 = 0 then 4 else 0 end + case when doc_id % 11 = 0 then 4 else 0 end)::double as ident,
    (case when doc_id % 2 = 0 then case when n_chars % 3 = 0 then 8 else 0 end + case when n_chars % 29 = 0 then 8 else 0 end + case when n_chars % 10 = 0 or (doc_id % 9 = 0 and doc_id % 13 <> 0) then 5 else 0 end
      else case when doc_id % 13 = 0 then 4 when doc_id % 9 = 0 then 5 else 0 end end)::double as dom from t),
    s as (select doc_id, least(m, 35.0) as model, least(au, 20.0) as authentication, least(u, 15.0) as url, least(ir, 10.0) as relay, least(attach, 15.0) as attachment, least(ident, 15.0) as identity, least(dom, 15.0) as domain from c),
    k as (select *, least(100.0, greatest(0.0, model + authentication + url + relay + attachment + identity + domain)) as score from s)"""


def _senders(r):
    """Adds the sender's domain, a displayed name, the reply-to and envelope addresses."""
    d = F.col("doc_id")
    r = r.withColumn("sd", F.concat(F.lit("paypal"), (d % 3).cast("string"), F.when(d % 9 == 0, ".top").otherwise(".example")))
    return r.withColumns({
        "sender": F.concat(F.lit("x@"), "sd"), "name": F.when(d % 4 == 0, F.concat(F.lit("Paypal"), (d % 3).cast("string"), F.lit(" Desk"))).when(d % 4 == 1, "Bank Desk").when(d % 4 == 2, "Al"),
        "reply_to": F.when(d % 5 == 0, "x@other.example").when(d % 5 == 1, F.concat(F.lit("y@"), F.upper("sd"))), "envelope": F.when(d % 7 == 0, "b@bounce.example").otherwise(F.concat(F.lit("z@"), "sd")),
    })


def _canonical(t):
    r, n, d = _senders(_risk(t)), F.col("n_chars"), F.col("doc_id")
    every = lambda k: n % k == 0
    dom = F.when(d % 13 == 0, "q7x9z2k4w8v1m5j3b6.example").otherwise(F.col("sd"))
    points = scoring.capped({
        "MODEL": scoring.model_points(F.col("p_spam"), F.col("p_phish"), F.col("p_legit"), F.col("tvd"), F.lit(True)),
        "AUTHENTICATION": scoring.auth_points(F.col("spf"), F.col("dkim"), F.col("dmarc"), F.col("p_phish")),
        "URL": scoring.url_points(every(11), every(7), every(5), F.lit(False), n % 13, F.lit(0.0)),
        "INFRASTRUCTURE_RELAY": scoring.relay_points(every(17), n % 12, every(9)),
        "ATTACHMENT": scoring.attachment_points(every(19), every(23), F.lit(False), every(4)),
        "IDENTITY": scoring.identity_points(F.col("sender"), F.col("name"), F.col("reply_to"), F.col("envelope"), d % 11 == 0),
        "DOMAIN": scoring.domain_points(dom, every(3), every(29), every(10), d % 2 == 0),
    })
    named = {"MODEL": "model", "AUTHENTICATION": "authentication", "URL": "url", "INFRASTRUCTURE_RELAY": "relay", "ATTACHMENT": "attachment", "IDENTITY": "identity", "DOMAIN": "domain"}
    s = r.select("doc_id", *[v.alias(named[k]) for k, v in points.items()])
    return s.withColumn("score", scoring.total([F.col(c) for c in named.values()]))


@query("risk_canonical", "CO-07 CO-07c CO-07d AG-22 MA-01 MP-02", f"with {RISK}, {POINTS} select doc_id, round(model, 6) as model, authentication, url, relay, attachment, identity, domain, round(score, 6) as score from k")
def risk_canonical(t):
    k = _canonical(t)
    return k.withColumns({"model": F.round("model", 6), "score": F.round("score", 6)})


@query("severity_policy", "CO-08 CO-09", f"with {RISK}, {POINTS}, v as (select case when score >= 75 then 'CRITICAL' when score >= 50 then 'HIGH' when score >= 25 then 'MEDIUM' else 'LOW' end as severity from k) select severity, case severity when 'CRITICAL' then 'PRIORITIZE_REVIEW' when 'HIGH' then 'ANALYST_REVIEW' when 'MEDIUM' then 'WARN' else 'ALLOW' end as action, count(*) as n from v group by 1, 2")
def severity_policy(t):
    s = _canonical(t).select(scoring.severity(F.col("score")).alias("severity"))
    return s.withColumn("action", scoring.action(F.col("severity"))).groupBy("severity", "action").agg(F.count(F.lit(1)).alias("n"))


@query("risk_legacy", "CO-06 AG-23", f"""with {RISK}, l as (select doc_id, case doc_id % 4 when 0 then 'phishing' when 1 then 'spammer' when 2 then 'legitimate' else 'suspicious' end as label, a, spf, dkim, dmarc, n_chars from t),
    v as (select doc_id, (case label when 'phishing' then 80 when 'spammer' then 60 when 'legitimate' then 10 else 40 end * a)::double as ml,
      greatest(case spf when 'PASS' then 0 when 'NONE' then 15 when 'SOFTFAIL' then 40 when 'FAIL' then 70 else 0 end, case dkim when 'PASS' then 0 when 'FAIL' then 70 when 'PERMERROR' then 50 else 0 end, case dmarc when 'FAIL' then 70 else 0 end)::double as auth,
      greatest(case when n_chars % 3 = 0 then 70 else 0 end, case when n_chars % 5 = 0 then 35 else 0 end)::double as url, (case when n_chars % 19 = 0 then 85 when n_chars % 7 = 0 then 70 else 0 end)::double as att,
      (case when doc_id % 5 = 0 then 60 when doc_id % 4 in (1, 2) then 50 else 0 end)::double as ident,
      greatest(case when n_chars % 29 = 0 then 70 else 0 end, case when n_chars % 10 = 0 then 30 else 0 end, case n_chars % 6 when 0 then 70 when 1 then 50 else 0 end, case when n_chars % 31 = 0 then 40 else 0 end)::double as dom,
      (case n_chars % 8 when 0 then 30 when 1 then 60 when 2 then 15 else 0 end)::double as head, (case when n_chars % 5 >= 3 then 30 else 0 end)::double as infra from l)
    select doc_id, round(least(100.0, greatest(0.0, ml * 0.25 + auth * 0.2 + url * 0.1 + att * 0.1 + ident * 0.1 + dom * 0.1 + head * 0.1 + infra * 0.05)), 6) as score from v""")
def risk_legacy(t):
    r, n, off = _senders(_risk(t)), F.col("n_chars"), F.lit(False)
    odd = F.when(n % 8 == 0, F.array(F.lit("no_received_headers"))).when(n % 8 == 1, F.array(F.lit("unusually_many_hops"), F.lit("non_monotonic_timestamps"))).when(n % 8 == 2, F.array(F.lit("only_one_hop")))
    label = F.when(F.col("doc_id") % 4 == 0, "phishing").when(F.col("doc_id") % 4 == 1, "spammer").when(F.col("doc_id") % 4 == 2, "legitimate").otherwise("suspicious")
    score = scoring.legacy_score({
        "ml_classification": scoring.legacy_label(label, F.col("a")), "authentication": scoring.legacy_auth(F.col("spf"), F.col("dkim"), F.col("dmarc")),
        "url_analysis": scoring.legacy_url(n % 3 == 0, n % 5 == 0, off, off), "attachment_risk": scoring.legacy_attachment(n % 19 == 0, n % 7 == 0, off),
        "identity_mismatch": scoring.legacy_identity(F.col("sender"), F.col("name"), F.col("reply_to")), "domain_intelligence": scoring.legacy_domain(n % 29 == 0, n % 10 == 0, F.when(n % 6 == 0, 1).when(n % 6 == 1, 3), n % 31 == 0),
        "header_anomalies": scoring.legacy_headers(odd), "infrastructure": scoring.legacy_infrastructure(n % 5),
    })
    return r.select("doc_id", F.round(score, 6).alias("score"))


FUSE = f"""{RISK}, q as (select *, ((n_chars * 13) % 101) / 100.0::double as quality from t), w as (select *, 1 / (1 + exp(-10 * (quality - 0.35))) as s, 1 / (1 + exp(3.5)) as s0, 1 / (1 + exp(-6.5)) as s1 from q),
    x as (select *, least(0.7, greatest(0.05, 0.05 + 0.65 * (s - s0) / (s1 - s0))) as alpha from w), f as (select *, alpha * p_legit + (1 - alpha) * q_legit as l, alpha * p_spam + (1 - alpha) * q_spam as sp, alpha * p_phish + (1 - alpha) * q_phish as ph from x),
    g as (select *, l / (l + sp + ph) as fl, sp / (l + sp + ph) as fs, ph / (l + sp + ph) as fp from f)"""


def _fused(t):
    r = _risk(t).withColumn("quality", ((F.col("n_chars") * 13) % 101) / 100.0)
    f = scoring.fused(P(), Q(), scoring.alpha(F.col("quality")))
    return r.withColumns({"alpha": scoring.alpha(F.col("quality")), "f0": f[0], "f1": f[1], "f2": f[2]})


@query("fusion_smooth", "MA-04 MA-06 CO-11 UD-05", f"with {FUSE} select doc_id, round(alpha, 6) as alpha, round(fl, 6) as legitimate, round(fs, 6) as spam, round(fp, 6) as phishing, round(least(1.0, greatest(0.0, fp + 0.45 * fs)), 6) as risk from g")
def fusion_smooth(t):
    f = [F.col("f0"), F.col("f1"), F.col("f2")]
    return _fused(t).select("doc_id", F.round("alpha", 6).alias("alpha"), *[F.round(c, 6).alias(n) for c, n in zip(f, scoring.CLASSES)], F.round(scoring.composite_risk(f), 6).alias("risk"))


ARG = lambda p: f"case when {p}_legit >= {p}_spam and {p}_legit >= {p}_phish then 'legitimate' when {p}_spam >= {p}_phish then 'spam' else 'phishing' end"


@query("tvd_disagreement", "MA-02 MA-05 AG-47 AG-60 CO-11", f"with {RISK}, d as (select tvd, {ARG('p')} as a, {ARG('q')} as b from t) select a, b, count(*) as n, round(avg(tvd), 6) as mean_tvd, bool_and(a = b) as agree from d group by 1, 2")
def tvd_disagreement(t):
    d = _risk(t).select("tvd", scoring.label_of(P()).alias("a"), scoring.label_of(Q()).alias("b"))
    return d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tvd"), 6).alias("mean_tvd"), F.bool_and(scoring.disagreement(F.col("a"), F.col("b")) == "AGREEMENT").alias("agree"))


@query("fusion_strategies", "AG-61 UD-05", f"""with {FUSE}, u as (select 'forensic_only' as strategy, p_legit a, p_spam b, p_phish c from g union all select 'semantic_only', q_legit, q_spam, q_phish from g
    union all select 'equal_average', (p_legit + q_legit) / 2, (p_spam + q_spam) / 2, (p_phish + q_phish) / 2 from g union all select 'fixed_weighted', 0.55 * p_legit + 0.45 * q_legit, 0.55 * p_spam + 0.45 * q_spam, 0.55 * p_phish + 0.45 * q_phish from g
    union all select 'smooth_evidence_weighted', fl, fs, fp from g) select strategy, count(*) as n, round(avg(c), 5) as mean_phishing, round(avg(greatest(a, b, c)), 5) as mean_confidence from u group by 1""")
def fusion_strategies(t):
    r = _risk(t).withColumn("quality", ((F.col("n_chars") * 13) % 101) / 100.0)
    s = scoring.strategies(P(), Q(), F.col("quality"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.array(*v).alias("p")) for k, v in s.items()]))
    rows = r.select(each.alias("x")).select("x.strategy", F.col("x.p")[2].alias("c"), F.array_max("x.p").alias("m"))
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 5).alias("mean_phishing"), F.round(F.avg("m"), 5).alias("mean_confidence"))


@query("escalations", "CO-11 MA-03", f"""with {FUSE}, e as (select doc_id, {ARG('p')} as a, {ARG('q')} as b, p_phish, q_phish, greatest(fl, fs, fp) as m, quality from g) select doc_id, (m < 0.6 or (a <> b and quality between 0.2 and 0.45)
    or (a = 'phishing' and p_phish >= 0.7 and b = 'legitimate') or (b = 'phishing' and q_phish >= 0.7 and a = 'legitimate')) as escalated from e""")
def escalations(t):
    f = [F.col("f0"), F.col("f1"), F.col("f2")]
    return _fused(t).select("doc_id", scoring.escalated(P(), Q(), f, F.col("quality")).alias("escalated"))


@query("content_points", "CO-07", r"""select doc_id, (case when regexp_matches(x, '\b(password|login|otp)\b', 'i') then 7 else 0 end + case when regexp_matches(x, '\b(gift card|bitcoin)\b', 'i') then 7 else 0 end + case when regexp_matches(x, '\b(urgent|expire)\b', 'i') then 4 else 0 end)::double as points
    from (select doc_id, text || case doc_id % 4 when 0 then ' Login now' when 1 then ' urgent gift card' when 2 then ' otp bitcoin expire' else '' end as x from documents)""")
def content_points(t):
    x = F.concat("text", F.expr("case doc_id % 4 when 0 then ' Login now' when 1 then ' urgent gift card' when 2 then ' otp bitcoin expire' else '' end"))
    return t("documents").select("doc_id", scoring.content_points(x).alias("points"))


# ---- features


def _mail(t):
    p = t("pages").select("page_id", text.html_text(F.col("html")).alias("body_text"), F.col("html").alias("body_html"))
    received = lambda i: F.concat(F.lit(f"from mx{i}.example.org ([198.18.{i}."), (F.col("page_id") % 250).cast("string"), F.lit(f"]) by in.example.com with ESMTP id {i}; Mon, {10 - i} Jan 2024 10:0{i}:00 +0000"))
    head = lambda n, v, i: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(i).alias("position"))
    sender = F.concat(F.lit("Payroll Team <hr@mail"), (F.col("page_id") % 9).cast("string"), F.lit(".example-pay.top>"))
    headers = F.array(head("Received", received(1), 0), head("Received", received(2), 1), head("From", sender, 2), head("To", F.lit("a@b.example"), 3), head("X-Mailer", F.lit("=?utf-8?q?x?="), 4))
    return p.withColumns({
        "from_raw": sender, "to_raw": F.lit("a@b.example"), "reply_to_raw": F.lit("x@gmail.com"), "subject": F.concat(F.lit("Invoice "), F.col("page_id").cast("string")),
        "headers": F.when(F.col("page_id") % 3 != 0, headers), "attachments": F.expr("array(struct('a.pdf.exe' as filename, 'application/pdf' as content_type, page_id * 10L as size))"),
        "auth": F.expr("named_struct('spf', 'fail', 'dkim', 'none', 'dkim_signatures', 0, 'dkim_reason', '', 'dmarc', 'fail', 'policy', 'reject', 'spf_aligned', false, 'dkim_aligned', false)"),
    })


@query("features", "UD-01 UD-02 SRC-19 FP-09 CO-16 SO-05")
def all_features(t):
    return features.extract(_mail(t), ["page_id"])


@query("evidence_quality", "CO-10")
def evidence_quality(t):
    f = features.extract(_mail(t), ["page_id"])
    return scoring.evidence_quality(f, features.names(), ["page_id"]).withColumn("quality", F.round("quality", 6))


# ---- raw mail and authentication

RAW = (
    b"Received: from a.example (a.example [192.168.1.1]) by b.example with ESMTPS; Mon, 1 Jan 2024 10:00:00 +0000\r\nReceived: from c ([10.0.0.1]) by a.example; Mon, 1 Jan 2024 09:00:00 +0000\r\n"
    b"Authentication-Results: mx; spf=fail smtp.mailfrom=x; dkim=none; dmarc=fail\r\nFrom: =?utf-8?q?J=C3=BCrgen?= <j@evil.example>\r\nTo: a@x.example, B <b@x.example>\r\nSubject: =?utf-8?b?SGk=?=\r\n"
    b"Date: Mon, 1 Jan 2024 11:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=Q\r\n\r\n--Q\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello http://x.example/a\r\n--Q\r\n"
    b"Content-Type: application/pdf; name=invoice.pdf\r\nContent-Disposition: attachment; filename=invoice.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERg==\r\n--Q--\r\n"
)


def _raw(t):
    spark = t("region").sparkSession
    return spark.createDataFrame([("a.eml", bytearray(RAW)), ("b.eml", bytearray(b"Subject: only headers\r\n\r\n")), ("c.eml", bytearray(b"\xff\xfe\x00"))], "path string, content binary")


@query("mime_parse", "SRC-02 SRC-03 SRC-04 SRC-05 SRC-06 SRC-07 MP-01")
def mime_parse(t):
    m = mime.mails(_raw(t))
    return m.select("path", (F.col("evidence_sha256") == F.col("raw_sha256")).alias("same_hash"), "subject", "sender", "sender_name", "body_text", F.size("headers").alias("n_headers"), F.size("attachments").alias("n_attachments"), F.size("to").alias("n_to"))


@query("received_parse", "ST-21 DT-01 ST-22")
def received_parse(t):
    h = mime.header_rows(mime.mails(_raw(t)))
    hops = h.filter("lower(name) = 'received'").select("path", "position", forensics.parsed_received(F.col("value")).alias("p")).select("path", "position", "p.*")
    claims = h.filter("lower(name) = 'authentication-results'").select("path", *[forensics.auth_claim(F.col("value"), m).alias(m) for m in ("spf", "dkim", "dmarc")])
    return hops.join(claims, "path", "left")


DNS = [("example.com", "TXT", "v=spf1 ip4:192.0.2.0/24 include:_spf.example.net mx ~all"), ("_spf.example.net", "TXT", "v=spf1 ip4:198.51.100.7 -all"), ("example.com", "MX", "mx.example.com"), ("mx.example.com", "A", "203.0.113.5"),
       ("loop.example", "TXT", "v=spf1 include:loop.example -all"), ("red.example", "TXT", "v=spf1 redirect=example.com")]


@query("spf_eval", "CO-03 SRC-16")
def spf_eval(t):
    spark = t("region").sparkSession
    rows = spark.createDataFrame([("192.0.2.9", "example.com"), ("198.51.100.7", "example.com"), ("203.0.113.5", "example.com"), ("8.8.8.8", "example.com"), ("8.8.8.8", "loop.example"), ("192.0.2.1", "red.example"), ("8.8.8.8", "none.example")], "ip string, domain string")
    return forensics.spf(rows, "ip", "domain", spark.createDataFrame(DNS, "name string, type string, value string"))


@query("dmarc_eval", "CO-04 CO-05 ST-23", """
    with r as (select c_custkey as id, case c_custkey % 3 when 0 then 'PASS' else 'FAIL' end as spf, case c_custkey % 4 when 0 then 'mail.corp.co.uk' when 1 then 'corp.co.uk' else 'other.example' end as sd, case c_custkey % 5 when 0 then 's' else 'r' end as sm,
      case c_custkey % 2 when 0 then 'PASS' else 'NONE' end as dkim, case c_custkey % 6 when 0 then 'a.b.corp.co.uk' when 2 then 'corp.co.uk' when 4 then 'co.uk' end as dd, case c_custkey % 11 when 0 then 's' else 'r' end as dm, c_custkey % 7 = 0 as none from customer),
    l as (select *, coalesce(sd = 'corp.co.uk' or (sd = 'mail.corp.co.uk' and (sm = 'r' or none)), false) as sa, coalesce(dd = 'corp.co.uk' or (dd = 'a.b.corp.co.uk' and (dm = 'r' or none)), false) as da from r)
    select id, case when none then 'NONE' when (spf = 'PASS' and sa) or (dkim = 'PASS' and da) then 'PASS' else 'FAIL' end as result, case when none then 'none' else 'reject' end as policy,
      case when none then 'none' when id % 13 = 0 then 'quarantine' else 'reject' end as subdomain_policy, sa as spf_aligned, da as dkim_aligned, case id % 3 when 0 then 'PERMERROR' when 1 then 'UNVERIFIED' else 'NONE' end as dkim from l""")
def dmarc_eval(t):
    n = F.col("c_custkey")
    record = F.when(n % 7 != 0, F.concat(F.lit("v=DMARC1; p=reject; aspf="), F.when(n % 5 == 0, "s").otherwise("r"), F.lit("; ADKIM = "), F.when(n % 11 == 0, "s").otherwise("r"), F.when(n % 13 == 0, "; sp=quarantine").otherwise("")))
    spf, dkim = F.when(n % 3 == 0, "PASS").otherwise("FAIL"), F.when(n % 2 == 0, "PASS").otherwise("NONE")
    by_spf = F.when(n % 4 == 0, "mail.corp.co.uk").when(n % 4 == 1, "corp.co.uk").otherwise("other.example")
    by_dkim = F.when(n % 6 == 0, "a.b.corp.co.uk").when(n % 6 == 2, "corp.co.uk").when(n % 6 == 4, "co.uk")
    d = forensics.dmarc(F.lit("corp.co.uk"), spf, by_spf, dkim, by_dkim, record)
    signed = F.when(n % 3 == 0, "v=1; a=rsa-sha256; d=x.example; bh=1").when(n % 3 == 1, "v=1; d=x.example; s=key")
    return t("customer").select(n.alias("id"), d.alias("d"), forensics.dkim_structure(signed).alias("dkim")).select("id", "d.*", "dkim")


# ---- streams


@query("tumbling_counts", "SM-07", "select time_bucket(interval 6 hour, ts) as start, time_bucket(interval 6 hour, ts) + interval 6 hour as end, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def tumbling_counts(t):
    return state.tumbling_counts(t("events"), "ts", "event_type", "6 hours").withColumn("total", F.round("total", 4))


@query("session_counts", "SM-05", """with s as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    g as (select user_id, ts, sum(new) over (partition by user_id order by ts, new) as k from s) select min(ts) as start, max(ts) + interval 30 minute as end, user_id, count(*) as n from g group by user_id, k""")
def session_counts(t):
    return state.sessions(t("events"), "ts", "user_id")


@query("circuit_breaker", "SM-03", """with recursive e as (select event_type, epoch_us(ts) / 1e6 as at_, event_id % 3 <> 0 as ok, row_number() over (partition by event_type order by ts, event_id % 3 <> 0) as k from events),
    r(event_type, k, state, failures, successes, opened, rejected) as (select distinct event_type, 0::bigint, 'closed', 0, 0, 0.0::double, 0 from events union all
      select event_type, k, case when rej then state when ok then case when half and successes < 1 then 'half_open' else 'closed' end when half or failures >= 2 then 'open' else state end,
        case when rej then failures when ok or half or failures >= 2 then 0 else failures + 1 end, case when rej then successes when ok and half and successes < 1 then successes + 1 else 0 end,
        case when not rej and not ok and (half or failures >= 2) then at_ else opened end, rejected + rej::int
      from (select e.*, r.* exclude (event_type, k), state = 'open' and at_ - opened < 3600 as rej, state <> 'closed' as half from r join e on e.event_type = r.event_type and e.k = r.k + 1))
    select event_type, state, failures, successes, opened, rejected from r qualify k = max(k) over (partition by event_type)""")
def circuit_breaker(t):
    return state.breaker_states(t("events"), "event_type", "ts", F.col("event_id") % 3 != 0, most_failures=3, wait=3600.0)


@query("token_bucket", "SM-04", """with recursive e as (select user_id, epoch_us(ts) / 1e6 as at_, row_number() over (partition by user_id order by ts) as k from events),
    r(user_id, k, last, tokens, allowed, denied) as (select user_id, k, at_, 2.0::double, 1, 0 from e where k = 1 union all
      select user_id, k, at_, case when h >= 1 then h - 1 else h end, allowed + (h >= 1)::int, denied + (h < 1)::int
      from (select e.user_id, e.k, at_, least(3.0, tokens + (at_ - last) * (1::double / 20000)) as h, allowed, denied from r join e on e.user_id = r.user_id and e.k = r.k + 1))
    select user_id, allowed, denied, round(tokens, 6) as tokens from r qualify k = max(k) over (partition by user_id)""")
def token_bucket(t):
    return state.token_bucket(t("events"), "user_id", "ts", 3.0, 1 / 20000)


# ---- models


@query("ml_tfidf_lr", "ML-01 AG-56")
def ml_tfidf_lr(t):
    labels = t("labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(labels, "doc_id", "left")

    def fit(rows):
        model = ml.text_classifier("text", "label", weight="weight").fit(ml.balanced(rows, "label"))
        return lambda df: ml.probability_of(model.transform(df), 1, "p").select("doc_id", "label", "prediction", F.round("p", 6).alias("p"))

    fold = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(5))
    return ml.out_of_fold(settled(d), "label", fold, 5, fit)


@query("ml_features_lr", "ML-02 ML-09")
def ml_features_lr(t):
    d = t("documents").join(t("labels"), "doc_id").withColumn("body_text", F.col("text"))
    f = settled(features.extract(d, ["doc_id", "quality"]))
    names = [n for n in features.names() if n.startswith(("cnt_", "msg_"))]
    rows = f.withColumn("label", F.col("quality").cast("double"))
    model = ml.tabular_logistic(names, "label").fit(rows)
    return ml.probability_of(model.transform(rows), 1, "p").select("doc_id", "label", "prediction", F.round("p", 6).alias("p"))


@query("temperature", "ML-05 MA-07", f"""with {RISK}, l as (select doc_id % 3 as y, ln(greatest(p_legit, 1e-6)) as a, ln(greatest(p_spam, 1e-6)) as b, ln(greatest(p_phish, 1e-6)) as c from t), g as (select 0.5::double + 0.05::double * unnest(range(71)) as t),
    n as (select g.t, avg(ln(exp(a / g.t) + exp(b / g.t) + exp(c / g.t)) - case y when 0 then a when 1 then b else c end / g.t) as nll from l, g group by 1) select arg_min(t, nll) as temperature from n""")
def temperature(t):
    r = _risk(t).select((F.col("doc_id") % 3).alias("y"), *[F.log(F.greatest(c, F.lit(1e-6))).alias(f"l{i}") for i, c in enumerate(P())])
    best = ml.temperature(r, ["l0", "l1", "l2"], F.col("y"))
    return r.sparkSession.range(1).select(F.lit(best).alias("temperature"))
