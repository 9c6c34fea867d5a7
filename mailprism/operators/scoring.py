"""Risk: the canonical engine of capped points, the legacy engine of weighted maxima, evidence quality, fusion, policy."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import net, text

CLASSES = ["legitimate", "spam", "phishing"]
# Caps of the canonical categories and weights of the legacy ones.
CAPS = {"MODEL": 35.0, "AUTHENTICATION": 20.0, "IDENTITY": 15.0, "DOMAIN": 15.0, "URL": 15.0, "ATTACHMENT": 15.0, "CONTENT_BEC": 15.0, "INFRASTRUCTURE_RELAY": 10.0}
LEGACY_WEIGHTS = {"ml_classification": 0.25, "authentication": 0.20, "identity_mismatch": 0.10, "domain_intelligence": 0.10, "url_analysis": 0.10, "attachment_risk": 0.10, "header_anomalies": 0.10, "infrastructure": 0.05}
LEGACY_AUTH = {"PASS": 0, "NONE": 15, "SOFTFAIL": 40, "FAIL": 70, "TEMPERROR": 20, "PERMERROR": 50, "NOT_CHECKED": 10}
LEGACY_HEADERS = {"no_received_headers": 30.0, "non_monotonic_timestamps": 60.0, "unusually_many_hops": 25.0, "only_one_hop": 15.0}
LEGACY_LABELS = {"legitimate": 10, "suspicious": 40, "phishing": 80, "spammer": 60}
# Weights of the dimensions of evidence quality.
QUALITY_WEIGHTS = {"rfc822_headers": 0.15, "auth_alignment": 0.15, "relay_hops": 0.10, "network_ip": 0.10, "domain_reputation": 0.10, "url_signals": 0.10, "attachment_metadata": 0.05, "body_content": 0.10, "sender_envelope_alignment": 0.05, "forensic_feature_density": 0.10}
# Brands that display names claim.
CLAIMED_BRANDS = ["paypal", "microsoft", "apple", "google", "amazon", "netflix", "bank", "security"]


def _on(c: Column, points: float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), points).otherwise(0.0)


def _any(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs])


# ---- distributions


def tvd(p: list[Column], q: list[Column]) -> Column:
    return F.least(F.lit(1.0), 0.5 * reduce(add, [F.abs(a - b) for a, b in zip(p, q, strict=True)]))


def normalized(p: list[Column]) -> list[Column]:
    """NaN and negatives as 0, sum 1; thirds where nothing is left; six digits."""
    clean = [F.when(F.isnan(x) | (x < 0) | x.isNull(), 0.0).otherwise(x) for x in p]
    total = reduce(add, clean)
    return [F.when(total > 0, F.round(x / total, 6)).otherwise(d) for x, d in zip(clean, (0.3333, 0.3333, 0.3334), strict=True)]


def legacy_label_mass(label: Column, confidence: Column) -> list[Column]:
    """A single label as a distribution; labels outside the three put their mass on phishing."""
    rest = (1 - confidence) / 2
    known = [F.when(label == c, confidence).otherwise(rest) for c in CLASSES[:2]]
    return [*known, F.when(label.isin(CLASSES[:2]), rest).otherwise(confidence)]


def softmax(x: list[Column], temperature: float = 1.0) -> list[Column]:
    e = [F.exp(v / temperature) for v in x]
    return [v / reduce(add, e) for v in e]


# ---- canonical engine


def model_points(p_spam: Column, p_phish: Column, p_legit: Column, distance: Column, available: Column) -> Column:
    by_phish = F.when(p_phish >= 0.7, 20 + 15 * (p_phish - 0.7) / 0.3).when(p_phish >= 0.4, 8 + 12 * (p_phish - 0.4) / 0.3).otherwise(0.0)
    by_spam = F.when(p_spam >= 0.5, 10 * p_spam).otherwise(0.0)
    by_legit = F.when((p_legit >= 0.8) & (p_phish < 0.2), -10 * (p_legit - 0.8) / 0.2).otherwise(0.0)
    return F.when(available, by_phish + by_spam + by_legit).otherwise(0.0) + F.when(distance >= 0.35, 5 * distance).otherwise(0.0)


def auth_points(spf: Column, dkim: Column, dmarc: Column, p_phish: Column) -> Column:
    spf, dkim, dmarc = (F.upper(c) for c in (spf, dkim, dmarc))
    passes = _any((spf == "PASS") & (dkim == "PASS") & (dmarc == "PASS"))
    return _on(dmarc == "FAIL", 12.0) + _on(spf.isin("FAIL", "SOFTFAIL", "PERMERROR"), 8.0) + _on(dkim.isin("FAIL", "PERMERROR"), 8.0) + _on(passes & (p_phish < 0.5), -5.0)


def identity_points(sender: Column, name: Column, reply_to: Column, envelope: Column, parsing_failure: Column | None = None) -> Column:
    of = lambda c: F.when(c.contains("@"), F.lower(F.trim(F.substring_index(c, "@", -1))))
    domain, low = F.coalesce(of(sender), F.lit("")), F.lower(name)
    prefix = F.substring_index(domain, ".", 1)
    claims = _any(*[low.contains(b) for b in CLAIMED_BRANDS])
    owns = _any(*[domain.contains(b) for b in CLAIMED_BRANDS])
    other = (prefix != "") & ~low.contains(prefix) & (F.length(name) > 3) & ~name.contains("@")
    named = (F.coalesce(sender, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    differs = lambda c: (domain != "") & (of(c) != domain)
    fails = parsing_failure if parsing_failure is not None else F.lit(False)
    return _on(named & ((claims & ~owns) | other), 8.0) + _on(differs(reply_to), 6.0) + _on(differs(envelope), 4.0) + _on(fails, 4.0)


def domain_points(domain: Column, lookalike: Column, homoglyph: Column, bad_tld: Column, analysed: Column) -> Column:
    """With an analysis its flags count, without one the top-level domain and the entropy of the sender's domain."""
    tld = domain.rlike(net.ENGINE_TLDS)
    with_ = _on(lookalike, 8.0) + _on(homoglyph, 8.0) + _on(_any(bad_tld, tld), 5.0)
    return F.when(analysed, with_).otherwise(_on(tld, 5.0) + _on(text.domain_entropy(domain) > 3.8, 4.0))


def url_points(is_ip: Column, shortener: Column, path: Column, punycode: Column, n: Column, best_score: Column) -> Column:
    flags = _any(is_ip, shortener, path, punycode)
    return _on(is_ip, 8.0) + _on(shortener, 4.0) + _on(path, 5.0) + _on(punycode, 5.0) + _on(n > 5, 3.0) + _on((best_score >= 0.5) & ~flags, 6.0)


def attachment_points(double: Column, dangerous: Column, mismatch: Column, archive: Column) -> Column:
    return _on(double, 10.0) + _on(dangerous, 10.0) + _on(mismatch, 5.0) + _on(archive, 4.0)


def relay_points(backwards: Column, hops: Column, private_origin: Column) -> Column:
    return _on(backwards, 5.0) + _on(hops > 8, 4.0) + _on(private_origin, 3.0)


def content_points(body: Column) -> Column:
    """Presence of wording, however often."""
    return _on(body.rlike(text.CREDENTIAL), 7.0) + _on(body.rlike(text.PAYMENT), 7.0) + _on(body.rlike(text.URGENCY), 4.0)


def capped(points: dict[str, Column]) -> dict[str, Column]:
    return {k: F.greatest(F.least(v, F.lit(CAPS[k])), F.lit(-CAPS[k])) for k, v in points.items()}


def total(categories: list[Column]) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), reduce(add, categories)))


def severity(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def confidence(available: Column, reliability: Column, distance: Column, consistency: Column, missing_models: Column) -> Column:
    c = 0.35 * available + 0.25 * reliability + 0.2 * (1 - distance) + 0.2 * consistency - 0.08 * missing_models
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def consistency(label: Column, active: Column) -> Column:
    legit = F.when(active == 0, 0.95).otherwise(F.greatest(F.lit(0.2), 0.95 - 0.25 * active))
    return F.when(label == "phishing", F.least(F.lit(1.0), 0.4 + 0.15 * active)).when(label == "legitimate", legit).otherwise(0.7)


def action(level: Column) -> Column:
    """What a severity recommends; every action may be undone and waits for approval."""
    return F.when(level == "CRITICAL", "PRIORITIZE_REVIEW").when(level == "HIGH", "ANALYST_REVIEW").when(level == "MEDIUM", "WARN").otherwise("ALLOW")


def top_factors(factors: Column, k: int = 5) -> Column:
    """The k factors (struct of points, id) with the most points."""
    return F.slice(F.sort_array(factors, asc=False), 1, k)


# ---- legacy engine


def legacy_auth(*results: Column) -> Column:
    points = []
    for r in results:
        c = F.lit(10)
        for k, v in LEGACY_AUTH.items():
            c = F.when(r == k, v).otherwise(c)
        points.append(F.when(r.isNull(), 0).otherwise(c))
    return F.greatest(F.lit(0), *points).cast("double")


def legacy_label(label: Column, conf: Column) -> Column:
    base = F.lit(30)
    for k, v in LEGACY_LABELS.items():
        base = F.when(label == k, v).otherwise(base)
    return F.when(label.isNull(), 0.0).otherwise(F.least(F.lit(100.0), base * conf))


def legacy_domain(homoglyph: Column, bad_tld: Column, nearest: Column, punycode: Column) -> Column:
    """nearest: edits to the nearest brand, null for none."""
    near = F.when(nearest.isNotNull(), F.greatest(F.lit(40.0), 80.0 - nearest * 10)).otherwise(0.0)
    return F.greatest(_on(homoglyph, 70.0), _on(bad_tld, 30.0), near, _on(punycode, 40.0))


def legacy_url(is_ip: Column, shortener: Column, path: Column, punycode: Column) -> Column:
    return F.greatest(_on(is_ip, 70.0), _on(shortener, 35.0), _on(path, 45.0), _on(punycode, 50.0))


def legacy_attachment(double: Column, dangerous: Column, mismatch: Column) -> Column:
    return F.greatest(_on(double, 85.0), _on(dangerous, 70.0), _on(mismatch, 50.0))


def legacy_identity(sender: Column, name: Column, reply_to: Column) -> Column:
    """50 if no word of three letters or more of the name is in the first label of the sender's domain, 60 if the reply-to
    domain is another."""
    of = lambda c: F.coalesce(F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1))), F.lit(""))
    domain, reply = of(sender), of(reply_to)
    first = F.substring_index(domain, ".", 1)
    named = F.exists(F.split(F.lower(name), r"\s+"), lambda w: (F.length(w) > 2) & first.contains(w))
    return F.greatest(_on((F.coalesce(name, F.lit("")) != "") & (first != "") & ~named, 50.0), _on((domain != "") & (reply != "") & (domain != reply), 60.0))


def legacy_headers(anomalies: Column) -> Column:
    """Of an array of anomalies of the relay path; null is none."""
    return F.greatest(F.lit(0.0), *[_on(F.array_contains(anomalies, k), v) for k, v in LEGACY_HEADERS.items()])


def legacy_infrastructure(most_warnings: Column) -> Column:
    """most_warnings: the warnings of the address that has most."""
    return _on(most_warnings >= 3, 30.0)


def legacy_score(categories: dict[str, Column]) -> Column:
    return total([v * LEGACY_WEIGHTS[k] for k, v in categories.items()])


# ---- evidence quality


def evidence_quality(features: DataFrame, feature_names: list[str], keep: list[str]) -> DataFrame:
    """keep, the ten dimensions, quality in [0, 1], tier and missing, from feature columns."""
    c = F.col
    core = reduce(add, [_on(c(f"hdr_{h}_present") > 0, 1.0) for h in ("from", "to", "date", "message_id")])
    headers = F.when((c("msg_header_count") >= 5) & (core >= 2), 1.0).when((c("msg_header_count") > 0) | (core > 0), F.least(F.lit(1.0), 0.2 + 0.2 * F.greatest(core, F.lit(1.0)))).otherwise(0.0)
    auth = reduce(add, [_on(c(f"auth_{m}_result") != -1, 1.0) for m in ("spf", "dkim", "dmarc")]) / 3
    relay = F.when(c("relay_hop_count") > 0, F.least(F.lit(1.0), 0.4 + 0.2 * F.least(c("relay_hop_count"), F.lit(3.0)))).otherwise(0.0)
    counted = lambda n: F.when(c(n) > 0, 1.0).when(c(n) == 0, F.when(headers > 0, 0.6).otherwise(0.1)).otherwise(0.0)
    w = c("msg_body_word_count")
    body = F.when(w >= 50, 1.0).when(w >= 20, 0.85).when(w >= 10, 0.55).when(w >= 3, 0.3).when(w > 0, 0.15).otherwise(0.0)
    fail, sender = c("ident_address_parsing_failure"), c("hdr_from_present") > 0
    envelope = F.when((fail == 0) & sender, 1.0).when((fail != -1) & sender, 0.5).otherwise(0.0)
    density = reduce(add, [_on(c(n) != -1, 1.0) for n in feature_names]) / len(feature_names)
    dims = {
        "rfc822_headers": headers, "auth_alignment": auth, "relay_hops": relay, "network_ip": _on(c("ip_originating_present") > 0, 1.0), "domain_reputation": _on(c("dom_sender_length") > 0, 1.0),
        "url_signals": counted("url_total_count"), "attachment_metadata": counted("att_total_count"), "body_content": body, "sender_envelope_alignment": envelope,
        "forensic_feature_density": F.when(headers > 0, density).otherwise(density * 0.25),
    }
    q = features.select(*keep, *[v.alias(k) for k, v in dims.items()])
    overall = F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(add, [F.col(k) * v for k, v in QUALITY_WEIGHTS.items()])))
    q = q.withColumn("quality", overall)
    missing = F.array_compact(F.array(*[F.when(F.col(k) == 0, k) for k in dims if k != "forensic_feature_density"]))
    return q.withColumns({"tier": quality_tier(F.col("quality")), "missing": missing})


def quality_tier(q: Column) -> Column:
    return F.when(q >= 0.7, "HIGH").when(q >= 0.4, "MEDIUM").when(q >= 0.2, "LOW").otherwise("DEGRADED")


# ---- fusion


def alpha(q: Column, low: float = 0.05, high: float = 0.7, middle: float = 0.35, steep: float = 10.0) -> Column:
    """Weight of the forensic model: a sigmoid of quality, scaled to reach both ends."""
    import math

    at = lambda x: 1 / (1 + math.exp(-steep * (x - middle)))
    s = 1 / (1 + F.exp(-steep * (F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)) - middle)))
    a = low + (high - low) * (s - at(0.0)) / (at(1.0) - at(0.0))
    return F.least(F.lit(high), F.greatest(F.lit(low), a))


def fused(p: list[Column], q: list[Column], weight: Column) -> list[Column]:
    mix = [weight * a + (1 - weight) * b for a, b in zip(p, q, strict=True)]
    return [x / reduce(add, mix) for x in mix]


def strategies(p: list[Column], q: list[Column], quality: Column) -> dict[str, list[Column]]:
    """Distributions of the strategies that need no training; a learned one takes meta_features."""
    return {
        "forensic_only": p, "semantic_only": q, "equal_average": fused(p, q, F.lit(0.5)), "fixed_weighted": fused(p, q, F.lit(0.55)),
        "smooth_evidence_weighted": fused(p, q, alpha(quality)),
    }


def label_of(p: list[Column]) -> Column:
    arr = F.array(*p)
    return F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(arr, F.array_max(arr)).cast("int"))


def composite_risk(p: list[Column]) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p[2] + 0.45 * p[1]))


def disagreement(a: Column, b: Column) -> Column:
    short = lambda c: F.when(c == "legitimate", "LEGIT").when(c == "spam", "SPAM").otherwise("PHISH")
    return F.when(a == b, "AGREEMENT").otherwise(F.concat(F.lit("FORENSIC_"), short(a), F.lit("_SEMANTIC_"), short(b)))


def escalated(p: list[Column], q: list[Column], f: list[Column], quality: Column, least: float = 0.6) -> Column:
    a, b = label_of(p), label_of(q)
    unsure = F.greatest(*f) < least
    conflict = (a != b) & quality.between(0.2, 0.45)
    far = ((a == "phishing") & (p[2] >= 0.7) & (b == "legitimate")) | ((b == "phishing") & (q[2] >= 0.7) & (a == "legitimate"))
    return unsure | conflict | far


def meta_features(p: list[Column], q: list[Column], quality: Column, dimensions: list[Column]) -> Column:
    """25 numbers for ten dimensions: both distributions, quality, its weight, whether the models differ, the dimensions, and
    the distributions times their weights."""
    w = alpha(quality)
    parts = [*p, *q, quality, w, (label_of(p) != label_of(q)).cast("double"), *dimensions, *[w * x for x in p], *[(1 - w) * x for x in q]]
    return F.array(*[x.cast("double") for x in parts])


def text_risk(label: Column, conf: Column, signals: list[tuple[Column, float]]) -> Column:
    """Base of the label times confidence plus weighted signals, capped at 1."""
    base = F.lit(0.3)
    for k, v in LEGACY_LABELS.items():
        base = F.when(label == k, v / 100).otherwise(base)
    return F.least(F.lit(1.0), base * conf + reduce(add, [s * w for s, w in signals], F.lit(0.0)))
