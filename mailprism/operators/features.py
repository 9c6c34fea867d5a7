"""The 125 features of a message in 11 groups, each a function from a frame's columns to named Columns.

Input columns (all nullable): subject, body_text, body_html, from_raw, to_raw, reply_to_raw, return_path_raw, date_raw, message_id, has_html,
headers ARRAY<STRUCT<name,value,position>> (null where raw evidence is absent), attachments ARRAY<STRUCT<filename,content_type,size>>,
auth STRUCT<spf,dkim,dkim_signatures,dkim_reason,dmarc,policy,spf_aligned,dkim_aligned>, origin STRUCT<asn,organization,country>.
-1 means unobserved, which is not the same as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import net, text
from .forensics import parsed_received

# Stable codes of results.
SPF_CODES = {"none": 0, "pass": 1, "neutral": 2, "softfail": 3, "fail": 4, "temperror": 5, "permerror": 6}
DKIM_CODES = {"none": 0, "pass": 1, "neutral": 2, "fail": 3, "temperror": 4, "permerror": 5}
DMARC_CODES = {"none": 0, "pass": 1, "fail": 2, "temperror": 3, "permerror": 4}
POLICY_CODES = {"none": 0, "quarantine": 1, "reject": 2}
# Roles that display names claim, and owners of hosting networks.
ROLES = ["ceo", "cfo", "cto", "cio", "president", "director", "executive", "payroll", "hr", "human resources", "admin", "administrator", "it support", "helpdesk", "security team", "billing", "accounts payable"]
CLOUDS = ["amazon", "aws", "microsoft", "azure", "google", "digitalocean", "cloudflare", "ovh", "hetzner", "linode", "akamai", "oracle", "vultr", "fastly"]

HEADERS = "array<struct<name:string,value:string,position:int>>"


def _n(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _code(c: Column, codes: dict[str, int]) -> Column:
    out = F.lit(-1.0)
    for k, v in codes.items():
        out = F.when(c == k, float(v)).otherwise(out)
    return out


def _where(observed: Column, value: Column, other: float) -> Column:
    return F.when(observed, value).otherwise(other)


def _has(c: Column) -> Column:
    return _n(F.coalesce(c, F.lit("")) != "")


def message_basics() -> dict[str, Column]:
    body = F.coalesce(F.nullif(F.col("body_text"), F.lit("")), F.col("body_html"), F.lit(""))
    html = F.coalesce(F.col("has_html"), F.lit(False)) | (F.coalesce("body_html", F.lit("")) != "")
    plain = F.when(F.col("headers").isNotNull(), F.coalesce("body_text", F.lit("")) != "").otherwise(~html)
    raw, h = F.col("headers").isNotNull(), F.col("headers")
    n_att = F.coalesce(F.size("attachments"), F.lit(0))
    both = html & plain
    count = lambda f: F.size(F.filter(h, f)).cast("double")
    return {
        "msg_subject_length": F.length(F.coalesce("subject", F.lit(""))).cast("double"), "msg_body_length": F.length(body).cast("double"),
        "msg_body_word_count": text.word_count(body), "msg_body_line_count": text.line_count(body), "msg_has_html": _n(html), "msg_has_plaintext": _n(plain),
        "msg_is_multipart": _where(raw, _n((n_att > 0) | both), 0.0), "msg_mime_part_count": _where(raw, 1.0 + n_att + _n(both), 1.0),
        "msg_header_count": _where(raw, F.size(h).cast("double"), -1.0), "msg_custom_header_count": _where(raw, count(lambda x: F.lower(x["name"]).startswith("x-")), -1.0),
        "msg_encoded_header_count": _where(raw, count(lambda x: x["value"].contains("=?") & x["value"].contains("?=")), 0.0),
        "msg_malformed_header_count": _where(raw, count(lambda x: F.trim(x["name"]) == ""), 0.0),
    }


def header_signals() -> dict[str, Column]:
    raw, names = F.size("headers") > 0, F.transform("headers", lambda x: F.lower(x["name"]))
    raw = F.coalesce(raw, F.lit(False)) & F.col("headers").isNotNull()
    fallback = {"from": _has(F.col("from_raw")), "to": _has(F.col("to_raw")), "cc": F.lit(0.0), "reply-to": _has(F.col("reply_to_raw")), "message-id": _has(F.col("message_id")), "date": _has(F.col("date_raw"))}
    out = {}
    for h in ("from", "to", "cc", "reply-to", "return-path", "message-id", "date", "received", "authentication-results", "x-originating-ip", "user-agent", "x-mailer", "list-unsubscribe"):
        name = {"authentication-results": "auth_results"}.get(h, h.replace("-", "_"))
        out[f"hdr_{name}_present"] = F.when(raw, _n(F.array_contains(names, h))).otherwise(fallback.get(h, F.lit(-1.0)))
    times = lambda h: F.size(F.filter(names, lambda x: x == h))
    out["hdr_received_count"] = _where(raw, times("received").cast("double"), -1.0)
    twice = F.lit(False)
    for h in ("from", "to", "subject", "date", "message-id"):
        twice = twice | (times(h) > 1)
    out["hdr_duplicate_security_headers"] = _where(raw, _n(twice), 0.0)
    return out


def authentication_signals() -> dict[str, Column]:
    seen = F.col("headers").isNotNull() & F.col("auth").isNotNull()
    res = lambda c: F.lower(F.coalesce(F.col(f"auth.{c}"), F.lit("none")))
    spf, dkim, dmarc = res("spf"), res("dkim"), res("dmarc")
    state = lambda c, good, bad, none: F.when(c.isin(good), 1.0).when(c.isin(bad + none), 0.0).otherwise(-1.0)
    a, b = F.coalesce(F.col("auth.spf_aligned"), F.lit(False)), F.coalesce(F.col("auth.dkim_aligned"), F.lit(False))
    out = {
        "auth_spf_result": _code(spf, SPF_CODES), "auth_spf_pass": state(spf, ["pass"], ["fail", "softfail", "permerror"], ["none", "neutral"]),
        "auth_spf_fail": state(spf, ["fail", "softfail", "permerror"], ["pass"], ["none", "neutral"]), "auth_dkim_result": _code(dkim, DKIM_CODES),
        "auth_dkim_pass": state(dkim, ["pass"], ["fail", "permerror"], ["none", "neutral"]), "auth_dkim_fail": state(dkim, ["fail", "permerror"], ["pass"], ["none", "neutral"]),
        "auth_dkim_signature_count": _n(F.col("auth.dkim_signatures")), "auth_dkim_body_hash_failure": _n(F.lower(F.coalesce(F.col("auth.dkim_reason"), F.lit(""))).contains("body hash mismatch")),
        "auth_dmarc_result": _code(dmarc, DMARC_CODES), "auth_dmarc_pass": F.when(dmarc == "pass", 1.0).when(dmarc == "fail", 0.0).otherwise(-1.0),
        "auth_dmarc_policy": _code(F.lower(F.coalesce(F.col("auth.policy"), F.lit("none"))), POLICY_CODES),
        "auth_alignment_dmarc": F.when(a & b, 3.0).when(a | b, 2.0).when(dmarc != "none", 1.0).otherwise(0.0),
    }
    return {k: _where(seen, v, -1.0) for k, v in out.items()}


def identity_consistency() -> dict[str, Column]:
    name, domain, reply, path = (F.col(c) for c in ("_name", "_domain", "_reply", "_path"))
    differs = lambda a, b: _n(F.coalesce(a != b, F.lit(False)))
    depth = F.coalesce(F.greatest(F.lit(0), F.size(F.split(domain, r"\.")) - 2), F.lit(0)).cast("double")
    clean = F.coalesce(domain, F.lit(""))
    claims = name.contains("@") | name.contains(".com") | name.contains(".net") | name.contains(".org")
    role = F.lit(False)
    for r in ROLES:
        role = role | name.contains(r)
    reply_differs = F.coalesce(domain != reply, F.lit(False))
    weak = clean.isin(net.FREEMAIL) | (depth > 1) | reply_differs | net.tld(clean).isin("xyz", "top", "icu", "club", "buzz", "click", "download")
    return {
        "ident_display_name_present": _n(name != ""), "ident_address_parsing_failure": _n(domain.isNull()), "ident_from_reply_to_mismatch": _n(reply_differs),
        "ident_from_return_path_mismatch": differs(domain, path), "ident_sender_org_domain_mismatch": differs(net.organizational_domain(domain), net.organizational_domain(reply)),
        "ident_subdomain_depth": depth, "ident_display_name_domain_inconsistency": _n(domain.isNotNull() & claims & ~F.coalesce(name.contains(domain), F.lit(False))),
        "ident_freemail_sender": _n(clean.isin(net.FREEMAIL)), "ident_disposable_sender": _n(clean.isin(net.DISPOSABLE)), "ident_display_name_role_spoof": _n(role & weak),
    }


def _private(ip: Column) -> Column:
    return F.when(ip.contains(":"), F.lower(ip).rlike("^(::1$|f[cd]|fe[89ab])")).otherwise(F.coalesce(net.is_private(ip), F.lit(False)))


def relay_path() -> dict[str, Column]:
    raw, values, good4, good6, v4, v6, ips, hops, delays = (F.col(c) for c in ("headers", "_received", "_good4", "_good6", "_v4", "_v6", "_ips", "_hops", "_delays"))
    raw = raw.isNotNull()
    positive = F.transform(delays, lambda d: F.greatest(F.lit(0.0), d))
    some = F.size(delays) > 0
    size = lambda a: F.size(a).cast("double")
    total = F.aggregate(positive, F.lit(0.0), lambda a, d: a + d)
    out = {
        "relay_hop_count": (size(values), -1.0), "relay_unique_ip_count": (size(F.array_distinct(ips)), -1.0), "relay_ipv4_count": (size(good4), -1.0), "relay_ipv6_count": (size(good6), -1.0),
        "relay_private_ip_count": (size(F.filter(ips, _private)), -1.0), "relay_public_ip_count": (size(F.filter(ips, lambda x: ~_private(x))), -1.0),
        "relay_malformed_ip_count": (size(v4) + size(v6) - size(ips), 0.0), "relay_missing_timestamp_count": (size(F.filter(hops, lambda h: h["timestamp"].isNull())), -1.0),
        "relay_max_hop_delay_sec": (F.when(some, F.array_max(positive)).otherwise(-1.0), -1.0), "relay_avg_hop_delay_sec": (F.when(some, total / F.size(delays)).otherwise(-1.0), -1.0),
        "relay_timestamp_ordering_anomaly": (_n(F.exists(delays, lambda d: d < -60)), 0.0), "relay_first_public_ip_present": (_n(F.exists(hops, lambda h: h["source_ip"].isNotNull() & ~_private(h["source_ip"]))), 0.0),
    }
    return {k: _where(raw, v, other) for k, (v, other) in out.items()}


def ip_infrastructure() -> dict[str, Column]:
    o = F.col("_origin")
    there = F.col("headers").isNotNull() & o.isNotNull()
    ip = o["ip"]
    has = lambda c: F.coalesce(F.col(f"origin.{c}").cast("string"), F.lit("")) != ""
    org = F.lower(F.coalesce(F.col("origin.organization"), F.lit("")))
    cloud = org.rlike("|".join(CLOUDS))
    return {
        "ip_originating_present": _n(there), "ip_originating_is_private": _where(there, _n(_private(ip)), -1.0), "ip_originating_version": _where(there, F.when(ip.contains(":"), 6.0).otherwise(4.0), 0.0),
        "ip_originating_asn_present": _n(there & has("asn")), "ip_originating_org_present": _n(there & has("organization")), "ip_originating_country_present": _n(there & has("country")),
        "ip_originating_cloud_hosting": _n(there & cloud), "ip_originating_confidence": _where(there, o["confidence"], 0.0),
    }


def helpers() -> list[dict[str, Column]]:
    """Columns that several features read, in layers: each is computed once and then only named."""
    values, hops = F.col("_received"), F.col("_hops")
    matches = lambda p: F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(p), F.lit(0))))
    micros = F.col("_micros")
    last = F.greatest(F.size(micros) - 1, F.lit(0))
    own = F.filter("headers", lambda x: F.lower(x["name"]).isin("x-originating-ip", "x-sender-ip"))
    pair = lambda ip, c: F.struct(ip.alias("ip"), F.lit(c).alias("confidence"))
    public, private = F.filter("_hop_ips", lambda x: ~_private(x)), F.filter("_hop_ips", _private)
    both = F.concat_ws(" ", F.col("body_text"), F.col("body_html"))
    rows = F.coalesce("attachments", F.array().cast("array<struct<filename:string,content_type:string,size:bigint>>"))
    return [
        {
            "_received": F.transform(F.filter("headers", lambda x: F.lower(x["name"]) == "received"), lambda x: x["value"]),
            "_own": F.regexp_extract(F.coalesce(F.get(own, F.lit(0))["value"], F.lit("")), r"(\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F:]{3,39})", 1),
            "_name": F.lower(net.display_name(F.col("from_raw"))), "_domain": net.address_domain(F.col("from_raw")),
            "_reply": net.address_domain(F.col("reply_to_raw")), "_path": net.address_domain(F.col("return_path_raw")),
            "_url": F.regexp_extract_all(both, F.lit(net.URL), F.lit(0)),
            "_att": F.transform(rows, lambda a: F.struct(
                a["filename"].alias("f"), F.coalesce(a["content_type"], F.lit("application/octet-stream")).alias("t"), F.coalesce(a["size"].cast("long"), F.lit(0)).alias("s"), net.extension(a["filename"]).alias("e"))),
            "_both": F.trim(F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit("")))),
            "_said": F.concat_ws(" ", net.display_name(F.col("from_raw")), F.coalesce("subject", F.lit("")), F.coalesce("body_text", F.lit(""))),
        },
        {
            "_v4": matches(net.IPV4), "_v6": matches(r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"), "_hops": F.reverse(F.transform(values, parsed_received)),
            "_urls": F.array_distinct("_url"), "_sender": net.normalized_domain(F.col("_domain")),
        },
        {
            "_good4": F.filter("_v4", net.is_ipv4), "_good6": F.filter("_v6", lambda x: F.size(F.split(x, ":")) == 8),
            "_micros": F.transform(F.filter(hops, lambda h: h["timestamp"].isNotNull()), lambda h: F.unix_micros(h["timestamp"])),
            "_hop_ips": F.transform(F.filter(hops, lambda h: h["source_ip"].isNotNull()), lambda h: h["source_ip"]), "_parts": F.transform("_urls", net.url_parts),
        },
        {
            "_ips": F.concat("_good4", "_good6"), "_delays": F.zip_with(F.slice(micros, F.lit(1), last), F.slice(micros, F.lit(2), last), lambda a, b: (b - a) / 1e6),
            # an originating header, else the oldest public hop, else the oldest private one
            "_origin": F.when(F.col("_own") != "", pair(F.col("_own"), 0.9)).when(F.size(public) > 0, pair(F.get(public, F.lit(0)), 0.75)).when(F.size(private) > 0, pair(F.get(private, F.lit(0)), 0.3)),
        },
    ]


def domain_signals() -> dict[str, Column]:
    d = F.col("_sender")
    there, labels = d.isNotNull(), F.size(F.split(d, r"\."))
    digits = F.regexp_count(d, F.lit("[0-9]")).cast("double")
    out = {
        "length": F.length(d).cast("double"), "label_count": labels.cast("double"), "subdomain_depth": F.greatest(F.lit(0), labels - 2).cast("double"), "numeric_count": digits,
        "hyphen_count": F.regexp_count(d, F.lit("-")).cast("double"), "digit_ratio": digits / F.length(d), "punycode": _n(d.contains("xn--")),
        "suspicious_tld": _n(F.substring_index(d, ".", -1).isin(net.SUSPICIOUS_TLDS)), "cctld": _n(F.substring_index(d, ".", -1).rlike(r"^\p{L}{2}$")),
        "homoglyph": _n(net.has_homoglyphs(d)), "entropy": F.round(text.entropy(d), 4),
    }
    return {f"dom_sender_{k}": _where(there, v, 0.0) for k, v in out.items()}


def url_signals() -> dict[str, Column]:
    raw, urls, parts = F.col("_url"), F.col("_urls"), F.col("_parts")
    n = lambda f: F.size(F.filter(parts, f)).cast("double")
    lengths = F.transform(urls, lambda u: F.length(u))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    return {
        "url_total_count": F.size(raw).cast("double"), "url_unique_count": F.size(urls).cast("double"), "url_http_count": n(lambda p: p["scheme"] == "http"), "url_https_count": n(lambda p: p["scheme"] == "https"),
        "url_ip_literal_count": n(lambda p: net.is_ipv4(p["host"])), "url_max_length": _n(F.array_max(lengths)), "url_avg_length": F.round(_n(F.try_divide(total, F.size(urls))), 2),
        "url_has_query": _n(F.exists(parts, lambda p: p["query"] != "")), "url_has_port": _n(F.exists(parts, lambda p: (p["port"] != "") & ~p["port"].isin("80", "443"))),
        "url_has_userinfo": _n(F.exists(parts, lambda p: p["has_userinfo"])), "url_has_shortener": _n(F.exists(parts, lambda p: p["host"].isin(net.SHORTENERS))),
        "url_suspicious_tld_count": n(lambda p: net.tld(p["host"]).isin(net.SUSPICIOUS_TLDS)),
    }


def attachment_signals() -> dict[str, Column]:
    rows = F.col("_att")
    n = lambda f: F.size(F.filter(rows, lambda a: F.coalesce(f(a), F.lit(False)))).cast("double")
    return {
        "att_total_count": F.size(rows).cast("double"), "att_executable_count": n(lambda a: a["e"].isin(net.DANGEROUS)), "att_archive_count": n(lambda a: a["e"].isin(net.ARCHIVES)),
        "att_script_count": n(lambda a: a["e"].isin(net.SCRIPTS)), "att_macro_count": n(lambda a: a["e"].isin(net.MACROS)), "att_double_extension_count": n(lambda a: net.double_extension(a["f"])),
        "att_mime_mismatch_count": n(lambda a: net.mime_mismatch(a["t"], a["e"])), "att_max_size_bytes": _n(F.array_max(F.transform(rows, lambda a: a["s"]))),
        "att_rfc822_count": n(lambda a: F.lower(a["t"]).startswith("message/rfc822") | (a["e"] == "eml")),
    }


def content_structure() -> dict[str, Column]:
    subject, html = F.coalesce("subject", F.lit("")), F.coalesce("body_html", F.lit(""))
    body = F.coalesce("body_text", F.lit(""))
    both = F.col("_both")
    letters, upper = text.count_of(both, r"\p{L}"), text.count_of(both, r"\p{Lu}")
    ratio = F.coalesce(F.try_divide(upper, letters), F.lit(0.0))
    visible = F.when(body != "", F.length(body)).otherwise(F.length(F.regexp_replace(html, "<[^>]+>", "")))
    invisible = F.length(both) > F.length(F.translate(both, text.INVISIBLE, ""))
    out = {
        "uppercase_ratio": F.round(ratio, 4), "digit_ratio": F.round(text.share_of(both, r"\p{Nd}"), 4), "punctuation_ratio": F.round(text.share_of(both, r"[!-/:-@\[-`{-~]"), 4),
        "exclamation_count": text.count_of(both, "!"), "question_count": text.count_of(both, r"\?"), "currency_symbol_count": text.count_of(both, "[$€£¥₹]"),
        "excessive_capitalization": _n((ratio > 0.35) & (letters >= 30)), "repeated_chars_detected": _n(text.repeated_character(both)), "whitespace_anomaly": _n(both.rlike(r"(\r?\n\s*){5,}")),
        "html_text_ratio": F.when(html != "", F.round(text.count_of(html, "<[^>]+>") / F.greatest(F.lit(1), visible), 4)).otherwise(0.0),
        "hidden_text_detected": _n(html.rlike(text.HIDDEN_TEXT)), "unicode_anomaly": _n(invisible | subject.rlike(r"[^\x00-\x7F]")),
    }
    return {f"cnt_{k}": F.when(both != "", v).otherwise(0.0) for k, v in out.items()}


def bec_phish_signals() -> dict[str, Column]:
    both = F.col("_said")
    return {f"bec_{k}": text.lexicon_count(both, terms) for k, terms in text.LEXICONS.items()}


GROUPS = (message_basics, header_signals, authentication_signals, identity_consistency, relay_path, ip_infrastructure, domain_signals, url_signals, attachment_signals, content_structure, bec_phish_signals)

INPUT = {
    "subject": "string", "body_text": "string", "body_html": "string", "from_raw": "string", "to_raw": "string", "reply_to_raw": "string", "return_path_raw": "string",
    "date_raw": "string", "message_id": "string", "has_html": "boolean", "headers": HEADERS, "attachments": "array<struct<filename:string,content_type:string,size:bigint>>",
    "auth": "struct<spf:string,dkim:string,dkim_signatures:int,dkim_reason:string,dmarc:string,policy:string,spf_aligned:boolean,dkim_aligned:boolean>",
    "origin": "struct<asn:bigint,organization:string,country:string>",
}
#: Columns that would leak the target into training.
FORBIDDEN = ["normalized_label", "threat_type", "original_label", "source_dataset", "label", "target", "is_phishing", "is_spam", "ground_truth"]


def extract(mail: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the 125 features, a projection a group, so that generated code stays small. Absent inputs are null."""
    have = {c: (F.col(c) if c in mail.columns else F.lit(None)).cast(t).alias(c) for c, t in INPUT.items()}
    df = mail.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *have.values())
    done: list[str] = []
    inputs = list(INPUT)
    for layer in helpers():
        df = df.select(*df.columns, *[v.alias(k) for k, v in layer.items()])
        inputs += list(layer)
    for group in GROUPS:
        new = group()
        df = df.select(*[f"_k{i}" for i in range(len(keep))], *inputs, *done, *[v.cast("double").alias(k) for k, v in new.items()])
        done += list(new)
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *done)


def names(spark=None) -> list[str]:
    """The registry's order; needs an active session, as groups are built of Columns."""
    return [k for group in GROUPS for k in group()]


def invalid(features: DataFrame, feature_names: list[str]) -> DataFrame:
    """Rows with a null, NaN or infinite feature."""
    bad = F.lit(False)
    for n in feature_names:
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return features.filter(bad)


def without_group(features: DataFrame, prefix: str) -> DataFrame:
    return features.select(*[c for c in features.columns if not c.startswith(prefix)])


def perturbed(features: DataFrame, prefixes: list[str], value: float = -1.0) -> DataFrame:
    return features.withColumns({c: F.lit(value) for c in features.columns if any(c.startswith(p) for p in prefixes)})
