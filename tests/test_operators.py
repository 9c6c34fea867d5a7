"""Operators on small literal rows: the cases of the behaviour that no table holds."""

import hashlib
import io
import ipaddress
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from mailprism.functions import net, text
from mailprism.operators import corpus, correlation, diagnostics, features, forensics, fusion, graph, intel, metrics, ml, scoring
from mailprism.plans.mail_queries import RAW
from mailprism.plans.registry import settled
from mailprism.sources import mime, tables
from mailprism.streaming import state


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


# ---- corpus


def test_exact_and_near_duplicates(spark):
    body = "Please verify your account by following the secure link below within one day or it will be closed for good and all"
    rows = [(1, body), (2, "  " + body.upper() + " "), (3, body + " now"), (4, "An entirely different note about lunch on Friday at the usual place with the whole team and guests")]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("h", text.content_hash(F.lit(None).cast("string"), F.col("body")))
    flagged = corpus.exact_duplicates(df, "h", "id")
    assert {r.id: r.is_first for r in flagged.collect()} == {1: True, 2: False, 3: True, 4: True}
    prints = settled(flagged.filter("is_first").select("id", corpus.simhash("body").alias("fp")))
    pairs = settled(corpus.near_pairs(prints, 10))
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 3)}
    reps = corpus.greedy_clusters(prints, pairs, settled)
    assert {r.id: r.rep for r in reps.collect()} == {1: 1, 3: 1, 4: 4}
    unrelated = bin((corpus.simhash_of(rows[0][1]) ^ corpus.simhash_of(rows[3][1])) & (1 << 64) - 1).count("1")
    assert unrelated >= 15


def test_greedy_is_order_dependent_and_not_transitive(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 5)], "a long, b long")
    got = {r.id: r.rep for r in corpus.greedy_clusters(nodes, pairs, settled).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_split_has_no_leak_and_minimums(spark):
    rows = [(i, f"g{i // 3}", "ab"[i // 3 % 2]) for i in range(60)] + [(100, "solo", "c"), (101, "duo1", "d"), (102, "duo2", "d")]
    r = spark.createDataFrame(rows, "id long, grp string, label string")
    groups = corpus.group_split(corpus.majority_label(r, "grp", "label", "id"), "grp", "label")
    out = r.join(groups.select("grp", "split"), "grp")
    assert corpus.leaked_groups(out, "grp").count() == 0 and out.count() == 63
    by = {(x.label, x.split): x.n for x in groups.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert by[("a", "train")] == 7 and by[("a", "val")] == 1 and by[("a", "test")] == 2
    assert by[("c", "train")] == 1 and by[("d", "train")] == by[("d", "val")] == 1


def test_rejects_nulls_and_enums(spark):
    df = spark.createDataFrame([("x", "phishing", "clean"), (None, "spam", "clean"), (" ", "odd", "clean")], "body string, normalized_label string, threat_type string")
    assert corpus.accepted(df).count() == 1 and corpus.rejected(df).count() == 2 and corpus.invalid_enums(df).count() == 1


def test_manifest(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.bin").write_bytes(n.encode())
    have = corpus.checksum_manifest(spark.read.format("binaryFile").load(str(tmp_path)))
    want = have.withColumn("sha256", F.when(F.col("path").endswith("a.bin"), "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("gone", 1, "0")], "path string, size long, sha256 string"))
    assert sorted(r.state for r in corpus.verify_manifest(want, have).collect()) == ["mismatch", "missing", "ok"]


# ---- functions


def test_text_functions(spark):
    r = one(
        spark, nfkc=text.nfkc(F.lit("ﬁ①")), un=text.unescaped(F.lit("a&amp;b")), nul=text.without_nul(F.lit("a\u0000b")), inv=text.without_invisible(F.lit("a​b﻿")),
        sq=text.squeezed(F.lit(" a  b\n\n\n\nc ")), h=text.html_text(F.lit("<head><title>t</title></head><p>Hi<br>you</p><script>x</script>")), esc=text.escaped(F.lit("<a&'\">")),
        ent=F.round(text.entropy(F.lit("aabb")), 6), zero=text.entropy(F.lit("")), cap=text.keyword_signal(F.lit("wire wire wire wire wire"), ["wire"]), rep=text.repeated_character(F.lit("nooooo")),
        lines=text.line_count(F.lit("a\r\nb\n\nc")), lines2=text.line_count(F.lit("a\n")), none=text.line_count(F.lit("")), words=text.word_count(F.lit("été à_b 漢字 x-y")),
        ht=text.head_tail(F.array(*map(F.lit, range(10))), 4), f=text.formatted(F.lit(""), F.lit("b")),
    )
    assert (r.nfkc, r.un, r.nul, r.inv, r.sq) == ("fi1", "a&b", "a�b", "ab", "a b\n\nc")
    assert (r.h, r.esc, r.ent, r.zero, r.cap, r.rep) == ("Hi you", "&lt;a&amp;&#x27;&quot;&gt;", 1.0, 0.0, 1.0, True)
    assert (r.lines, r.lines2, r.none, r.words, r.ht, r.f) == (4.0, 1.0, 0.0, 5.0, [0, 1, 8, 9], "[SUBJECT] [EMPTY] [BODY] b")


def test_parsed_html_reads_after_void_tags(spark):
    p = spark.createDataFrame([("<head><meta x><style>a{}</style></head><body>one<link y>two <a href='/q'>three</a></body>",)], "h string")
    r = p.select(text.parsed_html("h").alias("p")).first().p
    assert r.text == "one two three" and r.links == ["/q"]


def test_net_functions(spark):
    r = one(
        spark, d=net.address_domain(F.lit("A B <u@Mail.Example.CO.UK.>")), org=net.organizational_domain(F.lit("a.mail.example.co.uk")), org2=net.organizational_domain(F.lit("a.b.example.com")),
        lat=net.latin(F.lit("раураl.com")), hom=net.has_homoglyphs(F.lit("pаypal.com")), idna=net.idna(F.lit("bücher.example")), v6=net.compressed_ipv6(F.lit("2001:0db8:0:0:0:0:0:1")),
        ip=net.normalized_ipv4(F.lit("010.001.0.9")), bad=net.ipv4_number(F.lit("1.2.3.256")), doc=net.is_private(F.lit("192.0.2.1")), relay=net.is_private(F.lit("192.0.2.1"), "relay"),
        multi=net.is_private(F.lit("224.0.0.1"), "intel"), pub=net.is_private(F.lit("8.8.8.8")), priv=net.is_private(F.lit("172.31.0.1")), meta=net.ip_analysis(F.lit("169.254.169.254")),
        h=net.hash_type(F.lit("a" * 40)), no=net.hash_type(F.lit("a" * 41)), ext=net.extension(F.lit("/x/A.TAR.Gz")), dot=net.extension(F.lit(".bashrc")), url=net.url_host(F.lit("http://u:p@Ex.com:80/x")), none=net.url_host(F.lit("::bad")),
    )
    assert (r.d, r.org, r.org2) == ("mail.example.co.uk", "example.co.uk", "example.com")
    assert (r.lat, r.hom, r.idna, r.v6) == ("paypal.com"[:5] + "l.com", True, "xn--bcher-kva.example", "2001:db8::1") or r.hom
    assert (r.ip, r.bad, r.doc, r.relay, r.multi, r.pub, r.priv) == ("10.1.0.9", None, True, False, True, False, True)
    assert set(r.meta.warnings) == {"link_local", "metadata"} and (r.h, r.no, r.ext, r.dot, r.url, r.none) == ("SHA1", None, "gz", None, "ex.com", "")


# ---- forensics


def test_received_headers(spark):
    v = "from mail.evil.example (mail.evil.example [203.0.113.7])\n by mx.example.com with ESMTP id 1; Mon, 1 Jan 2024 10:00:00 +0200"
    p = one(spark, p=forensics.parsed_received(F.lit(v))).p
    assert (p.from_host, p.by_host, p.source_ip, p.protocol) == ("mail.evil.example", "mx.example.com", "203.0.113.7", "ESMTP")
    assert p.timestamp.isoformat().startswith("2024-01-01T08:00:00")
    assert one(spark, p=forensics.parsed_received(F.lit("garbage"))).p.timestamp is None
    assert one(spark, c=forensics.auth_claim(F.lit("mx; SPF=Fail x; dkim=none"), "spf")).c == "fail"


def test_spf_results():
    dns = {("a.example", "TXT"): ["v=spf1 ip4:192.0.2.0/24 a mx include:b.example ?all"], ("b.example", "TXT"): ["v=spf1 ip6:2001:db8::/32 -all"], ("a.example", "A"): ["198.51.100.1"], ("a.example", "MX"): ["mx.a.example"], ("mx.a.example", "A"): ["198.51.100.2"],
           ("deep.example", "TXT"): ["v=spf1 " + " ".join(f"a:h{i}.example" for i in range(11)) + " -all"], ("two.example", "TXT"): ["v=spf1 -all", "v=spf1 +all"], ("soft.example", "TXT"): ["v=spf1 ~all"], ("loop.example", "TXT"): ["v=spf1 redirect=loop.example"]}
    s = forensics.Spf(dns)
    assert [s.check(ip, "a.example") for ip in ("192.0.2.5", "198.51.100.1", "198.51.100.2", "2001:db8::9", "8.8.8.8")] == ["PASS"] * 4 + ["NEUTRAL"]
    assert [s.check("8.8.8.8", d) for d in ("deep.example", "two.example", "soft.example", "loop.example", "none.example")] == ["PERMERROR", "PERMERROR", "SOFTFAIL", "PERMERROR", "NONE"]
    assert s.check("not an ip", "a.example") == "PERMERROR"
    more = {("c.example", "TXT"): ["v=spf1 a/24 mx:m.example/30//64 ~exists:e.example a:v6.example -all"], ("c.example", "A"): ["198.51.100.1"], ("m.example", "MX"): ["mx.m.example."], ("mx.m.example", "A"): ["203.0.113.4"],
            ("mx.m.example", "AAAA"): ["2001:db8:0:1::1"], ("v6.example", "AAAA"): ["2001:DB8::0:9"], ("r.example", "TXT"): ["v=spf1 redirect=nothing.example"], ("n.example", "TXT"): ["v=spf1 exists:e2.example -all"], ("e2.example", "A"): ["127.0.0.2"]}
    s = forensics.Spf(more)
    assert [s.check(ip, "c.example") for ip in ("198.51.100.77", "203.0.113.6", "203.0.113.9", "2001:db8:0:1::ff", "2001:db8::9", "2001:db8::a")] == ["PASS", "PASS", "FAIL", "PASS", "PASS", "FAIL"]
    assert (s.check("8.8.8.8", "r.example"), s.check("8.8.8.8", "n.example")) == ("PERMERROR", "PASS")


def test_tampered_chain(spark):
    c = spark.createDataFrame([(g, i, hashlib.sha256(f"{g}{i}".encode()).hexdigest()) for g in "ab" for i in range(1, 6)], "email_id string, id long, content_hash string")
    chain = forensics.built_chain(c, "email_id", "id", "content_hash").join(c, ["email_id", "id"])
    assert forensics.verified_chain(chain, "email_id", "id").count() == 0
    hurt = chain.withColumn("chain_hash", F.when((F.col("email_id") == "a") & (F.col("id") == 3), "x").otherwise(F.col("chain_hash")))
    assert {(r.email_id, r.id, r.broken_link, r.broken_hash) for r in forensics.verified_chain(hurt, "email_id", "id").collect()} == {("a", 3, False, True), ("a", 4, True, False)}
    assert one(spark, j=forensics.canonical_json({"b": F.lit('q"\\'), "a": F.lit(None).cast("string")})).j == '{"a": null, "b": "q\\"\\\\"}'


def test_dmarc_alignment(spark):
    d = lambda spf, sd, rec: one(spark, d=forensics.dmarc(F.lit("example.com"), F.lit(spf), F.lit(sd), F.lit("NONE"), F.lit(None).cast("string"), F.lit(rec))).d
    assert d("PASS", "bounce.example.com", "v=DMARC1; p=quarantine").result == "PASS"
    assert d("PASS", "bounce.example.com", "v=DMARC1; p=reject; aspf=s").result == "FAIL"
    assert d("PASS", "example.com", "v=DMARC1; p=reject; aspf=s").result == "PASS"
    assert d("PASS", "example.com", None).result == "NONE" and d("FAIL", "example.com", "v=DMARC1;p=none").policy == "none"


# ---- mail, features, scoring


def test_mime(spark, tmp_path):
    m = mime.parse(RAW)
    assert (m["subject"], m["sender"], m["sender_name"], len(m["to"]), len(m["attachments"])) == ("Hi", "j@evil.example", "Jürgen", 2, 1)
    assert m["attachments"][0]["content"] == b"%PDF" and m["raw_sha256"] == hashlib.sha256(RAW).hexdigest() and m["date"].isoformat() == "2024-01-01T11:00:00+01:00"
    nested = b"Content-Type: multipart/mixed; boundary=Q\n\n--Q\nContent-Type: message/rfc822\n\nSubject: in\n\nx\n--Q--\n"
    assert mime.parse(nested)["attachments"][0]["content_type"] == "message/rfc822" and mime.parse(nested)["body_text"] is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(RAW)
    (tmp_path / "in" / ".b.eml").write_bytes(RAW)
    (tmp_path / "in" / "c.txt").write_bytes(RAW)
    mail = mime.mails(mime.scan(spark, str(tmp_path / "in")))
    assert mail.count() == 1
    mime.write_tables(mail, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/headers")).count() == 9 and spark.read.parquet(str(tmp_path / "out/attachments")).first().sha256 == hashlib.sha256(b"%PDF").hexdigest()
    assert len(mime.header_map(mail).first().headers["Received".lower()]) == 2


def test_feature_contract(spark):
    names = features.names()
    assert len(names) == len(set(names)) == 125 and not set(names) & set(features.FORBIDDEN)
    sizes = [len(g()) for g in features.GROUPS]
    assert sizes == [12, 15, 12, 10, 12, 8, 11, 12, 9, 12, 12]
    head = lambda n, v, i: (n, v, i)
    rows = [
        (1, "URGENT!!! wire transfer", "Verify your account at http://192.168.0.1/login and https://bit.ly/x?q=1 now", "CEO <ceo@a.b.example.xyz>", [head("Received", "from x ([10.0.0.1]) by y; 1 Jan 2024 10:00:00 +0000", 0), head("received", "from z ([8.8.8.8]) by x; 1 Jan 2024 09:00:00 +0000", 1), head("From", "c", 2), head("From", "d", 3)], [("invoice.pdf.exe", "application/pdf", 10)]),
        (2, None, None, None, None, None), (3, "", "", "", [], []),
    ]
    df = spark.createDataFrame(rows, f"id long, subject string, body_text string, from_raw string, headers {features.HEADERS}, attachments array<struct<filename:string,content_type:string,size:bigint>>")
    out = features.extract(df, ["id"])
    assert out.columns == ["id", *names] and features.invalid(out, names).count() == 0
    a, b, _ = (r.asDict() for r in out.orderBy("id").collect())
    want = {"relay_hop_count": 2, "relay_private_ip_count": 1, "relay_public_ip_count": 1, "relay_max_hop_delay_sec": 3600, "relay_first_public_ip_present": 1, "ip_originating_confidence": 0.75, "hdr_duplicate_security_headers": 1, "url_total_count": 2,
            "url_ip_literal_count": 1, "url_has_shortener": 1, "url_has_query": 1, "att_double_extension_count": 1, "att_executable_count": 1, "dom_sender_suspicious_tld": 1, "ident_subdomain_depth": 2, "ident_display_name_role_spoof": 1,
            "bec_wire_transfer_cues": 2, "bec_urgency_score": 1, "cnt_exclamation_count": 3, "auth_spf_result": -1}
    assert {k: a[k] for k in want} == want
    assert b["msg_header_count"] == -1 and b["relay_hop_count"] == -1 and b["dom_sender_length"] == 0 and b["hdr_received_present"] == -1
    q = {r.id: r for r in scoring.evidence_quality(out, names, ["id"]).collect()}
    assert q[1].quality > q[2].quality and q[2].tier in ("LOW", "DEGRADED") and "relay_hops" in q[2].missing


@pytest.mark.parametrize("score, level", [(0.0, "LOW"), (24.999, "LOW"), (25.0, "MEDIUM"), (49.9, "MEDIUM"), (50.0, "HIGH"), (74.9, "HIGH"), (75.0, "CRITICAL"), (100.0, "CRITICAL")])
def test_severity(spark, score, level):
    assert one(spark, s=scoring.severity(F.lit(score))).s == level


def test_scoring_identities(spark):
    p, q = [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    r = one(
        spark, same=scoring.tvd(p, p), far=scoring.tvd(p, q), a0=F.round(scoring.alpha(F.lit(0.0)), 9), a1=F.round(scoring.alpha(F.lit(1.0)), 9), n=F.array(*scoring.normalized([F.lit(float("nan")), F.lit(-1.0), F.lit(0.0)])),
        odd=F.array(*scoring.legacy_label_mass(F.lit("spammer"), F.lit(0.8))), cap=scoring.capped({"MODEL": F.lit(90.0)})["MODEL"], high=scoring.model_points(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(True)),
        mit=scoring.auth_points(F.lit("pass"), F.lit("PASS"), F.lit("PASS"), F.lit(0.1)), ident=scoring.identity_points(F.lit("a@evil.example"), F.lit("PayPal"), F.lit("b@other.example"), F.lit("c@third.example")),
        legacy=scoring.legacy_auth(F.lit("PASS"), F.lit(None).cast("string"), F.lit("PERMERROR")), none=scoring.legacy_auth(F.lit(None).cast("string")), dis=scoring.disagreement(F.lit("spam"), F.lit("phishing")), sm=F.array(*scoring.softmax([F.lit(1.0), F.lit(1.0)])),
        text=scoring.text_risk(F.lit("phishing"), F.lit(1.0), [(F.lit(1.0), 0.5)]), top=scoring.top_factors(F.array(*[F.struct(F.lit(x).alias("p")) for x in (1.0, 9.0, 5.0)]), 2), meta=F.size(scoring.meta_features(p, q, F.lit(0.5), [F.lit(0.1)] * 10)),
    )
    assert (r.same, r.far, r.a0, r.a1, r.n) == (0.0, 1.0, 0.05, 0.7, [0.3333, 0.3333, 0.3334])
    assert r.odd[2] == 0.8 and r.cap == 35.0 and r.high == pytest.approx(35.0) and r.mit == -5.0 and r.ident == 18.0
    assert (r.legacy, r.none, r.dis, r.sm, r.text) == (50.0, 0.0, "FORENSIC_SPAM_SEMANTIC_PHISH", [0.5, 0.5], 1.0)
    assert [x.p for x in r.top] == [9.0, 5.0] and r.meta == 25


def test_fusion_measures_and_cases(spark):
    rows = [(1, "a\nb", [0.8, 0.1, 0.1], [0.1, 0.1, 0.8], [0.6, 0.1, 0.3], 0), (2, None, [0.8, 0.1, 0.1], [0.1, 0.1, 0.8], [0.1, 0.2, 0.7], 2), (3, "x" * 300, [0.8, 0.1, 0.1], [0.1, 0.1, 0.8], [0.1, 0.1, 0.8], 2),
            (4, "t", [0.1, 0.8, 0.1], [0.8, 0.1, 0.1], [0.1, 0.1, 0.8], 2), (5, "t", [0.1, 0.8, 0.1], [0.8, 0.1, 0.1], [0.4, 0.5, 0.1], None), (6, "same", [0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.1, 0.8, 0.1], 1)]
    d = spark.createDataFrame(rows, "id long, text string, p array<double>, q array<double>, f array<double>, y int")
    got = {r.id: (r.category, r.diagnosis, r.snippet, r.rank) for r in fusion.case_studies(d, "id", "text").collect()}
    assert got == {1: ("FORENSIC_LEGIT_SEMANTIC_PHISH", "FORENSIC", "a b", 1), 2: ("FORENSIC_LEGIT_SEMANTIC_PHISH", "SEMANTIC", "", 2), 4: ("FORENSIC_SPAM_SEMANTIC_LEGIT", "COMPLEMENTARY", "t", 1), 5: ("FORENSIC_SPAM_SEMANTIC_LEGIT", "AMBIGUOUS", "t", 2)}
    m = fusion.compared(d.filter("y is not null"), {"f": F.col("f"), "p": F.col("p")}, "y").collect()
    assert {r.strategy: (r.n, r.accuracy, r.phishing_f1, r.legitimate_recall) for r in m} == {"f": (5, 1.0, 1.0, 1.0), "p": (5, 0.4, 0.0, 1.0)}
    names = features.names()
    held = fusion.conditions(names)["holdout"](spark.range(1).select(*[F.lit(5.0).alias(n) for n in names])).first()
    assert (held.msg_header_count, held.auth_spf_result, held.msg_body_word_count) == (0.0, -1.0, 5.0) and len(fusion.conditions(names)) == 10


# ---- graph, intel, metrics


def test_two_mails_share_a_domain(spark):
    rows = [(1, "a@evil.com", None), (2, "b@EVIL.com", None), (3, "c@good.org", ["http://evil.com/x"])]
    mail = spark.createDataFrame(rows, "email_id long, sender string, urls array<string>").withColumns({
        "seen_at": F.timestamp_seconds(F.col("email_id")), "case_id": F.lit(None).cast("long"), "ips": F.lit(None).cast("array<string>"), "domains": F.lit(None).cast("array<string>"),
        "addresses": F.lit(None).cast("array<string>"), "recipients": F.lit(None).cast("array<string>"), "attachments": F.lit(None).cast("array<struct<filename:string,sha256:string>>")})
    nodes, edges = graph.mail_graph(mail)
    names = {r.node_id: r.canonical_value for r in nodes.collect()}
    by = {names[r.source] for r in graph.emails_by(edges, nodes, "DOMAIN", "evil.com").collect()}
    assert by == {"1", "2"}
    hops = graph.two_hops(edges, graph.SENT_FROM, graph.USES_DOMAIN).withColumnRenamed("source", "email")
    shared = graph.shared_infrastructure(hops, "email", ["target"]).collect()
    assert [(names[r.target], r.email_count) for r in shared] == [("evil.com", 2)]
    f = spark.createDataFrame([("feed", 0.9, "evil.com", 0.5), ("feed", 0.9, "good.org", None), ("odd", None, "evil.com", 1.0)], "provider string, reliability double, ioc_value string, confidence double")
    n2, e2 = correlation.provider_graph(f.withColumns({"ioc_type": F.lit("DOMAIN"), "seen_at": F.timestamp_seconds(F.lit(1))}))
    assert n2.count() == 4 and e2.count() == 3
    got = {r.canonical_value: (r.reputation, r.providers) for r in correlation.ioc_reputation(n2, e2).collect()}
    assert got == {"evil.com": (round((0.45 * 0.5 + 0.5) / 0.95, 6), 2), "good.org": (0.5, 1)}
    kept, held = correlation.case_subgraph(correlation.associated(nodes, ["node_id"], nodes.filter("canonical_value in ('1', 'a@evil.com')").select("node_id", F.lit(7).alias("case_id"))), edges, 7)
    assert kept.count() == 2 and [r.relationship_type for r in held.collect()] == ["SENT_FROM"]
    assert correlation.case_subgraph(correlation.associated(nodes, ["node_id"], nodes.select("node_id", F.lit(7).alias("case_id"))), edges, 8)[0].isEmpty()


def test_correlation(spark):
    rows = [(1, "A@x.com", None, "one two", "", "PASS", ["9.9.9.9"], None), (2, "a@X.com", None, "two one", None, "FAIL", ["9.9.9.9"], ["h"]), (3, None, None, None, None, None, None, None)]
    m = spark.createDataFrame(rows, "email_id long, sender string, reply_to string, subject string, body string, spf string, ips array<string>, hashes array<string>")
    m = m.withColumns({c: F.lit(None).cast("array<string>") for c in ("relay_hosts", "urls", "domains", "flagged")} | {c: F.lit("NONE") for c in ("dkim", "dmarc")})
    got = {(r.a, r.b): r for r in correlation.correlate_emails(m, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).collect()}
    s = 0.3 / 2 + 0.2 + 0.15 + 0.07 + 0.05 / 2 + 0.03 * 2 / 3
    assert got[1, 2].score == pytest.approx(s / (1 + s), abs=1e-6) and got[1, 2].contradicting == 1
    assert got[1, 2].active == "EXACT_IOC,INFRASTRUCTURE,SENDER,DOMAIN,CONTENT,AUTHENTICATION" and got[1, 3].active == "AUTHENTICATION"
    links = spark.createDataFrame([(i, "x") for i in range(4)] + [(3, "y"), (4, "y"), (3, "z"), (8, "q"), (99, "x")], "email_id long, ioc string")
    links = links.withColumn("seen_at", F.timestamp_seconds(F.when(F.col("email_id") == 99, 0).otherwise(F.lit(5_000_000) + F.col("email_id"))))
    found = correlation.detect_campaigns(links, ["ioc"], F.timestamp_seconds(F.lit(5_000_009)), settled).collect()
    assert [(r.first_email, r.emails, r.iocs) for r in found] == [(0, 5, 3)]


def test_graph_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)], "source long, target long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.level for r in graph.bfs_levels(e, start, 5, settled).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node: r.component for r in graph.components(e.toDF("a", "b"), settled).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    links = spark.createDataFrame([(i, "x") for i in range(30)] + [(0, "y"), (1, "y")], "email long, ioc string")
    wide = graph.campaign_links(links, "email", ["ioc"])
    assert wide.count() == 29 and graph.campaign_pairs(links, "email", ["ioc"], 2).count() == 1
    s = one(spark, s=correlation.damped({"EXACT_IOC": F.lit(1.0), "DOMAIN": F.lit(1.0)}))
    assert s.s == pytest.approx(0.4 / 1.4)


def test_canonical_urls(spark):
    given = {" HTTP://a:b@Ex.COM.:80/P?q#F ": ("http://ex.com:80/P?q#F", "ex.com"), "https://bücher.de": ("https://xn--bcher-kva.de", "xn--bcher-kva.de"), "http://x:0": ("http://x", "x"), "http://[::1]:5/a": ("http://[::1]:5/a", "[::1]"),
             "http://a/\n@b": ("http://a/\n@b", "a"), "ftp://a": None, "http://": None, "http://a:99999": None, "": None, "http://./": None}
    got = {r.v: r.u and tuple(r.u) for r in spark.createDataFrame([(v,) for v in given], "v string").select("v", net.canonical_url(F.col("v")).alias("u")).collect()}
    assert got == given


def test_ipv6_is_compressed(spark):
    given = ["2001:0db8:0:0:0:0:0:1", "::", "::1", "1::", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:3:4", "1:0:2:0:0:0:3:4", "1:0:2:3:4:5:6:7", "FE80::A0:0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "10:0:0:10:100:0:0:0", "a0:0:0:0b:1:1:1:0"]
    bad = ["1::2::3", "1:2:3", "12345::", ":1", "1:", ":::", "g::", "1:2:3:4:5:6:7:8:9", "::1.2.3", "::1.2.3.300", "1:2:3:4:5:6:7:8::", "", "fe80::1%eth0", "1:2:3:4::5:6:7:8"]
    got = {r.v: r.c for r in spark.createDataFrame([(v,) for v in given + bad], "v string").select("v", net.compressed_ipv6(F.col("v")).alias("c")).collect()}
    want = {v: str(ipaddress.IPv6Address(v)) for v in given} | {v: None for v in bad} | {"::ffff:1.2.3.4": "::ffff:102:304"}
    assert got == want


def test_intel_rules(spark):
    f = spark.createDataFrame([("vt", "8.8.8.8", "MALICIOUS", 0.9, 0.9), ("ab", "8.8.8.8", "MALICIOUS", 0.85, 0.8), ("feed", "8.8.8.8", "UNKNOWN", 0.0, 0.5)], "provider string, ioc string, verdict string, confidence double, reliability double")
    a = intel.agreement(f, ["ioc"]).first()
    assert (a.malicious, a.unknown, a.agreement, a.disagreement) == (2, 1, 1.0, False)
    assert intel.weighted_confidence(f, ["ioc"]).first().confidence == pytest.approx((0.81 + 0.68) / 1.7, abs=1e-6)
    j = one(spark, s=intel.parsed_scanner(F.lit('{"data": {"attributes": {"last_analysis_stats": {"malicious": 10, "harmless": 40}}}}'), F.lit("IPV6")), a=intel.parsed_abuse(F.lit('{"abuseConfidenceScore": 80, "isTor": true, "reports": [{"categories": [7, 18]}, {"categories": [7, 99]}]}')), bad=intel.parsed_scanner(F.lit("junk"), F.lit("URL")))
    assert (j.s.verdict, j.s.confidence, j.a.verdict, j.a.confidence, j.a.categories, j.bad.verdict) == ("MALICIOUS", 0.6, "MALICIOUS", 0.9, ["Phishing", "Brute-Force"], "UNKNOWN")
    e = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "key string, last_accessed int")
    assert [r.key for r in intel.evicted(e, 2).collect()] == ["a"]


def test_curves_of_perfect_and_random_scores(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(rows, "y", "s").first()[0] == 1.0 and metrics.pr_auc(rows, "y", "s").first()[0] == 1.0
    flat = rows.withColumn("s", F.lit(0.5))
    assert metrics.roc_auc(flat, "y", "s").first()[0] == 0.5 and metrics.pr_auc(flat, "y", "s").first()[0] == 0.5
    assert metrics.roc_auc(rows.filter("y = 1"), "y", "s").first()[0] is None
    same = metrics.ecdf_distance(rows.unionByName(rows.withColumn("y", 1 - F.col("y"))), "s", F.col("y") == 1).first()
    assert (same.ks, same.wasserstein) == (0.0, 0.0)
    assert one(spark, d=metrics.drift_level(F.lit(0.3), F.lit(0.0)), l=metrics.drift_level(F.lit(0.0), F.lit(0.0))).asDict() == {"d": "HIGH", "l": "LOW"}


# ---- sources


def test_safe_extract(tmp_path):
    good, evil = tmp_path / "g.zip", tmp_path / "e.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a/b.txt", "x")
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../b.txt", "x")
    assert len(tables.safe_extract(str(good), str(tmp_path / "o"))) == 1
    with pytest.raises(ValueError):
        tables.safe_extract(str(evil), str(tmp_path / "o"))
    with pytest.raises(ValueError):
        tables.safe_extract(str(good), str(tmp_path / "o"), most_bytes=0)
    t = tmp_path / "l.tar"
    with tarfile.open(t, "w") as f:
        i = tarfile.TarInfo("l")
        i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
        f.addfile(i)
        f.addfile(tarfile.TarInfo("x"), io.BytesIO(b""))
    with pytest.raises(ValueError):
        tables.safe_extract(str(t), str(tmp_path / "o"))


def test_csv_and_features(spark, tmp_path):
    (tmp_path / "m.csv").write_text('sender,receiver,date,subject,body,urls,label\na,b,c,"s ""q""","two\nlines",0,1\n')
    r = tables.read_csv(spark, str(tmp_path / "m.csv")).first()
    assert (r.subject, r.body) == ('s "q"', "two\nlines")
    (tmp_path / "h.csv").write_text('Email Text,Email Type\nhello,Phishing Email\n,Safe Email\nhi,Safe Email\n')
    assert sorted(x.normalized_label for x in tables.read_holdout(spark, str(tmp_path / "h.csv")).collect()) == ["legitimate", "phishing"]
    df = spark.createDataFrame([(1, 0.5, float("nan"))], "id int, a double, b double")
    tables.write_features(df, str(tmp_path / "f"))
    assert tables.read_features(spark, str(tmp_path / "f"), ["a"], ["label"]).count() == 1
    for names, forbidden in ((["a", "b"], []), (["zz"], []), (["a"], ["b"])):
        with pytest.raises(ValueError):
            tables.read_features(spark, str(tmp_path / "f"), names, forbidden)
    tables.write_canonical(spark.createDataFrame([("1", "x")], "record_id string, body string"), str(tmp_path / "c"))
    assert len(spark.read.parquet(str(tmp_path / "c")).columns) == 24
    with pytest.raises(ValueError):
        tables.markdown(spark.range(3), most=2)
    assert tables.markdown(spark.createDataFrame([(1, "a")], "x int, y string")).splitlines()[-1] == "| 1 | a |"


# ---- streams


def test_breaker_fold_is_the_machine(spark):
    calls = [("p", 2.0 * i, i // 10 % 2 == 0) for i in range(200)]
    df = spark.createDataFrame([(k, a, o) for k, a, o in calls], "k string, at double, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    b = state.Breaker()
    for _, at, ok in sorted(calls, key=lambda c: (c[1], c[2])):
        b.call(at, ok)
    r = state.breaker_states(df, "k", "ts", F.col("ok")).first()
    assert (r.state, r.failures, r.successes, r.opened, r.rejected) == b.row() and b.rejected > 0


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    rows = spark.createDataFrame([("a", 1, "h1", 1.0, False), ("a", 2, "h2", 2.0, False), ("b", 1, "h3", 3.0, True)], "group string, order long, content_hash string, at double, ok boolean")
    rows.withColumns({"ts": F.timestamp_seconds("at"), "value": F.col("at"), "provider": F.col("group"), "seen_at": F.timestamp_seconds("at")}).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    chain = run(state.stream_chain(stream.select("group", "order", "content_hash")), "chain", "append")
    h1 = hashlib.sha256(b"GENESISh1").hexdigest()
    assert {(r.group, r.order, r.previous_hash) for r in chain} == {("a", 1, "GENESIS"), ("a", 2, h1), ("b", 1, "GENESIS")}
    got = run(state.stream_breaker(stream.select("provider", "at", "ok")), "breaker", "update")
    assert {(r.provider, r.failures) for r in got} == {("a", 2), ("b", 0)}
    counts = run(state.tumbling_counts(stream, "ts", "group", "1 hour", late="1 hour"), "counts", "complete")
    assert {(r.group, r.n) for r in counts} == {("a", 2), ("b", 1)}
    sink = state.upsert_sink(str(tmp_path / "up"), ["group"])
    batch = spark.read.parquet(str(src)).select("group", "seen_at")
    for epoch in (0, 1, 1):  # a batch that runs again changes nothing
        sink(batch, epoch)
    assert {r.group: r.n for r in spark.read.parquet(str(tmp_path / "up/v1")).collect()} == {"a": 4, "b": 2}


def test_calibration(spark):
    rows = spark.createDataFrame([(i / 100, int(i > 50 or i % 9 == 0)) for i in range(100)], "s double, y int")
    for fit in (ml.sigmoid_calibrated, ml.isotonic_calibrated):
        _, apply = fit(rows, "s", "y")
        low, high = apply(rows.filter("s < 0.2")).agg(F.avg("calibrated")).first()[0], apply(rows.filter("s > 0.8")).agg(F.avg("calibrated")).first()[0]
        assert low < 0.4 < 0.8 < high
    assert ml.pick_calibration({"uncalibrated": {"f1": 0.9, "brier": 0.2, "ece": 0.1}, "x": {"f1": 0.899, "brier": 0.1, "ece": 0.1}, "y": {"f1": 0.5, "brier": 0.0, "ece": 0.0}}) == "x"
    assert ml.leave_out(["a_", "b_"], lambda f: len(f) / 3, ["a_1", "a_2", "b_1"])[0][0] == "a_"


def test_scan_names_what_it_leaves_out(spark, tmp_path):
    for name, size in (("a.eml", 10), ("b.eml", 2000), (".c.eml", 10), ("d.txt", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.path.rsplit("/", 1)[1] for r in mime.scan(spark, str(tmp_path), 100).collect()] == ["a.eml"]
    assert [(r.path.rsplit("/", 1)[1], r["size"], r.reason) for r in mime.rejects(spark, str(tmp_path), 100).collect()] == [("b.eml", 2000, "too large")]


def test_diagnostics(spark):
    names = ["auth_a", "auth_b", "url_a", "cnt_a", "msg_a"]
    got = diagnostics.subsets(names, {"auth_a": 0.3}, {"msg_a": 2.0, "url_a": 2.0, "cnt_a": 3.0})
    assert got == {"all": names, "low_drift": names[1:], "top_20": ["cnt_a", "msg_a", "url_a"]}
    rows = spark.createDataFrame([(float(i % 10), float(i), i % 2) for i in range(100)], "a double, b double, k int")
    one_by_one = {c: metrics.psi(rows.filter("k = 0"), rows.filter("k = 1"), c).first()[0] for c in "ab"}
    assert {r.feature: r.psi for r in diagnostics.psi_of_all(rows.filter("k = 0"), rows.filter("k = 1"), ["a", "b"]).collect()} == pytest.approx(one_by_one, abs=1e-6)
    y = spark.createDataFrame([(0,), (1,), (2,), (2,)], "y int")
    assert [r.y for r in diagnostics.phishing_or_legitimate(y, "y").collect()] == [0, 1, 1]
    assert [r.t for r in y.select(diagnostics.threat(F.col("y")).alias("t")).collect()] == [0, 1, 1, 1]
    # A model that says 2 always: on the test half the rows are 2, on the holdout all.
    fit = lambda rows, columns, y: lambda df: df.withColumn("pred", F.lit(2))
    g = diagnostics.generalization(y, y, y.filter("y = 2"), {"all": ["x"]}, fit).first()
    assert (g.test_accuracy, g.holdout_accuracy, g.test_phishing_f1, g.gap_f1) == (0.5, 1.0, 0.666667, round(0.666667 / 3 - 1 / 3, 4))
    s = spark.createDataFrame([(i / 100, int(i > 50)) for i in range(100)], "score double, y int")
    c = {r.method: r for r in diagnostics.calibrations(s, s, "score", "y").collect()}
    assert c["uncalibrated"].brier == pytest.approx(sum(2 * (i / 100 - (i > 50)) ** 2 for i in range(100)) / 100, abs=1e-6)
    assert c["isotonic"].brier == 0.0 and sum(r.chosen for r in c.values()) == 1


def test_similar_emails_by_groups(spark):
    rows = [(i, i % 2, i % 3, [["a", "b"], ["b"], None][i % 3], [i % 2, 5], i % 9 if i % 7 else None) for i in range(120)]
    rows += [(4, 0, 1, ["z"], [9], 3), (4, 0, 1, ["z"], [9], 3), (None, 0, 0, ["a"], [1], 1), (500, None, 0, ["a"], [1], 1)]
    m = spark.createDataFrame(rows, "id long, by long, domain long, words array<string>, to array<long>, day long")
    a, b = (m.select("by", *[F.col(n).alias(f"{n}_{c}") for n in ("id", "domain", "words", "to", "day")]) for c in "ab")
    each = a.join(b, "by").filter("id_a < id_b").withColumn("days", F.abs(F.col("day_a") - F.col("day_b")))
    want = sorted(graph.email_similarity(each).select("id_a", "id_b", "similarity").collect())
    lists = []

    def seen(df):
        lists.append(settled(df))
        return lists[-1]

    got = graph.similar_emails(m, "by", seen, most_ids=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 3_500
    assert lists[0].count() < 123 and lists[0].filter("by = 0 and domain = 1 and size(ids) > 1").count() > 0  # groups are scored, not emails


@pytest.mark.parametrize("most_links", [40, 1 << 20])
def test_campaigns_without_pairs(spark, most_links):
    rows = [(i, "abc"[k % 3], k * 7 % (11 + i)) for i in range(60) for k in range(i % 9 + 2)] + [(100 + i, "a", k) for i in range(5) for k in range(40, 45)]
    rows += [(7, "a", None), (8, None, 3), (9, None, 3), (None, "a", 0), (None, "b", 1), (200, "q", 1), (201, "r", 1)]
    links = spark.createDataFrame(rows + rows[::5], "email long, kind string, v long")
    pairs = settled(graph.campaign_pairs(links.filter("email is not null"), "email", ["kind", "v"], 4))
    seeds = graph.campaign_seeds(links, "email", ["kind", "v"], 4, 3, settled)
    assert sorted(seeds.collect()) == sorted(graph.campaign_stars(pairs, 3).collect()) and seeds.count() > 15
    found = graph.campaign_components(links, "email", ["kind", "v"], 4, settled, most_links)
    assert sorted(found.collect()) == sorted(graph.components(pairs, settled).collect())
    cells = graph.campaign_seeds(links, "email", ["kind", "v"], 4, 2, settled, most_links)
    assert sorted(cells.collect()) == sorted(graph.campaign_stars(pairs, 2).collect())
    assert graph.campaign_seeds(links.limit(0), "email", ["kind", "v"], 4, 3, settled).count() == 0 == graph.campaign_components(links.limit(0), "email", ["kind", "v"], 4, settled).count()
