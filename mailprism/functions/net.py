"""Addresses, domains, URLs, attachments and hashes as Column builders."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import text_or_empty

# URL shorteners.
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bl.ink", "lnkd.in", "rb.gy", "cutt.ly", "shorturl.at", "v.gd", "j.mp"]
# Suspicious top-level domains of the URL and domain analyzers, and those of the risk engine.
SUSPICIOUS_TLDS = ["xyz", "top", "club", "work", "info", "buzz", "icu", "tk", "ml", "ga", "cf", "gq", "click", "download", "racing", "win", "bid", "loan"]
ENGINE_TLDS = r"(?i)\.(xyz|top|work|click|link|gq|ml|cf|tk|ga|buzz|loan|racing|fit|cam)$"
# Paths of credential pages.
SUSPICIOUS_PATH = r"(?i)/(login|signin|auth|verify|secure|update|confirm|account|password|credential|banking)"
# Brands that lookalikes are held against.
BRANDS = ["paypal.com", "google.com", "microsoft.com", "apple.com", "amazon.com", "facebook.com", "instagram.com", "twitter.com", "linkedin.com", "netflix.com", "bankofamerica.com", "wellsfargo.com", "chase.com", "dropbox.com", "dhl.com", "fedex.com", "ups.com"]
# Characters that look like Latin ones, and those.
HOMOGLYPHS = (
    "аеорсухԁ‐‑‒–—"
    "０１２３４５６７８９",
    "aeopcyxo-----0123456789",
)
# Two-part suffixes under which organisations register.
TWO_PART_SUFFIXES = ["co.uk", "gov.uk", "org.uk", "ac.uk", "net.uk", "gov.in", "co.in", "ac.in", "net.in", "org.in", "nic.in", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "govt.nz", "co.jp", "ne.jp", "or.jp", "go.jp", "ac.jp", "com.br", "org.br", "net.br", "gov.br"]
# Mail providers open to all, and those for throw-away addresses.
FREEMAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "protonmail.com", "proton.me", "aol.com", "icloud.com", "mail.com", "zoho.com", "yandex.com"]
DISPOSABLE = ["10minutemail.com", "tempmail.com", "guerrillamail.com", "mailinator.com", "trashmail.com", "throwawaymail.com", "sharklasers.com"]
# File extensions by kind.
DANGEROUS = ["exe", "scr", "bat", "cmd", "com", "pif", "vbs", "vbe", "js", "jse", "wsf", "wsh", "ps1", "msi", "msp", "mst", "cpl", "hta", "inf", "reg", "rgs", "sct", "shb", "shs", "lnk", "app", "jar", "class", "workflow", "command", "csh", "ksh", "bash", "zsh", "fish"]
ARCHIVES = ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "cab"]
DOCUMENTS = ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "pub", "pdf", "jpg", "jpeg", "png", "gif", "bmp"]
SCRIPTS = ["js", "jse", "vbs", "vbe", "wsf", "wsh", "ps1", "bat", "cmd", "sh", "bash", "py", "pl"]
MACROS = ["docm", "xlsm", "pptm", "dotm", "xltm", "xlam", "ppam", "ppsm", "sldm"]
# Extensions that a MIME type allows.
MIME_EXTENSIONS = {
    "application/x-msdownload": ["exe", "dll", "scr"],
    "application/x-executable": ["exe", "elf"],
    "application/x-bat": ["bat"],
    "application/x-vbs": ["vbs"],
    "application/javascript": ["js"],
    "text/x-script": ["vbs", "js"],
}
# Private, reserved and local IPv4 networks; documentation networks are separate, as variants differ there.
PRIVATE_NETS = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4"]
DOCUMENTATION_NETS = ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"]

URL = r"(?i)https?://[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=%-]+"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


# ---- URLs


def urls_in(c: Column) -> Column:
    """URLs of a text in order, without the punctuation that ends them, each once."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")))


def url_host(u: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none. Never throws."""
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", ""))


def url_parts(u: Column) -> Column:
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.struct(
        F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
        url_host(u).alias("host"),
        F.regexp_extract(authority, r":([^:@\]]*)$", 1).alias("port"),
        F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        authority.contains("@").alias("has_userinfo"),
    )


def normalized_url(u: Column) -> Column:
    """Host in lower case, the rest as it is; null unless http or https."""
    head = F.regexp_extract(u, r"(?i)^(https?://[^/?#]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substr(u, F.length(head) + 1)))


def is_ipv4(h: Column) -> Column:
    return h.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")


def tld(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def url_analysis(u: Column) -> Column:
    """Flags of one URL and their additive score."""
    p = url_parts(u)
    host = p["host"]
    flags = [
        ("is_ip_url", is_ipv4(host), 0.3),
        ("is_shortener", host.isin(SHORTENERS), 0.2),
        ("suspicious_tld", tld(host).isin(SUSPICIOUS_TLDS), 0.15),
        ("excessive_subdomains", F.regexp_count(host, F.lit(r"\.")) > 3, 0.15),
        ("has_punycode", host.startswith("xn--"), 0.2),
        ("suspicious_path", p["path"].rlike(SUSPICIOUS_PATH), 0.15),
    ]
    score = sum((F.when(flag, w).otherwise(0.0) for _, flag, w in flags), F.lit(0.0))
    return F.struct(*[flag.alias(n) for n, flag, _ in flags], F.round(F.least(F.lit(1.0), score), 6).alias("risk_score"))


# ---- domains and addresses


def normalized_domain(d: Column) -> Column:
    return F.lower(F.rtrim(F.trim(d), F.lit(".")))


@F.pandas_udf(T.StringType())
def idna(s: pd.Series) -> pd.Series:
    """ASCII form of a domain; itself where it has none."""

    def one(x: str) -> str:
        try:
            return x.encode("idna").decode("ascii")
        except UnicodeError:
            return x

    return s.map(one, na_action="ignore")


def canonical_url(u: Column) -> Column:
    """(url, host) of a web address: scheme and host in lower case, the host in ASCII form without a last dot, no user, the
    port unless 0, the rest as it is; null for anything else. Only hosts that are not ASCII go to Python."""
    form = r"(?is)^(https?)://(?:[^/?#]*@)?([^/?#:@\[\]]+|\[[0-9a-f:.]+\])(?::([0-9]{0,9}))?([/?#].*)?$"
    t = F.trim(u)
    part = lambda i: F.regexp_extract(t, form, i)
    host, port = F.rtrim(F.lower(part(2)), F.lit(".")), F.regexp_extract(t, form, 3).try_cast("int")
    host = F.coalesce(idna(F.when(~host.rlike(r"^[\x00-\x7f]*$"), host)), host)
    url = F.concat(F.lower(part(1)), F.lit("://"), host, F.when(port > 0, F.concat(F.lit(":"), port.cast("string"))).otherwise(""), part(4))
    ok = t.rlike(form) & (host != "") & F.coalesce(port <= 65535, F.lit(True))
    return F.when(ok, F.struct(url.alias("url"), host.alias("host")))


def latin(d: Column) -> Column:
    return F.translate(d, *HOMOGLYPHS)


def has_homoglyphs(d: Column) -> Column:
    return d != latin(d)


def main_domain(d: Column) -> Column:
    return F.when(d.contains("."), F.substring_index(d, ".", -2)).otherwise(d)


def organizational_domain(d: Column) -> Column:
    two = F.substring_index(d, ".", -2)
    return F.when(two.isin(TWO_PART_SUFFIXES), F.substring_index(d, ".", -3)).otherwise(two)


def address_domain(a: Column) -> Column:
    """Domain of an address, with or without a display name; null for none."""
    bare = F.coalesce(F.nullif(F.regexp_extract(a, r"<([^<>]*)>", 1), F.lit("")), F.trim(a))
    domain = F.when(bare.contains("@"), F.substring_index(bare, "@", -1)).otherwise(bare)
    return F.nullif(F.lower(F.rtrim(F.trim(domain), F.lit("."))), F.lit(""))


def display_name(a: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text_or_empty(a), r"^([^<]*)<", 1), '"', ""))


def lookalikes(domains: DataFrame, column: str, brands: list[str] = BRANDS) -> DataFrame:
    """(domain, brand, distance, similarity_pct) within 3 edits; brands are a fixed short list, held in the plan."""
    rows = domains.select(F.col(column).alias("domain"), main_domain(latin(normalized_domain(F.col(column)))).alias("m"))
    rows = rows.withColumn("brand", F.explode(F.array(*map(F.lit, brands))))
    rows = rows.withColumn("distance", F.levenshtein("m", "brand", 3)).filter(F.col("distance").between(1, 3))
    longest = F.greatest(F.length("m"), F.length("brand"))
    return rows.select("domain", "brand", "distance", F.round((1 - F.col("distance") / longest) * 100, 1).alias("similarity_pct"))


def domain_risk(homoglyph: Column, punycode: Column, bad_tld: Column, n_lookalikes: Column) -> Column:
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), on(homoglyph, 0.4) + on(punycode, 0.3) + on(bad_tld, 0.15) + F.least(F.lit(0.3), n_lookalikes * 0.15)), 6)


# ---- IP addresses


def ipv4_number(ip: Column) -> Column:
    """The address as a number, leading zeros dropped; null if it is none."""
    parts = [F.try_element_at(F.split(ip, r"\."), F.lit(i)) for i in range(1, 5)]
    n = [p.try_cast("int") for p in parts]
    ok = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    for x in n:
        ok = ok & (x <= 255)
    return F.when(ok, ((n[0].cast("long") * 256 + n[1]) * 256 + n[2]) * 256 + n[3])


def normalized_ipv4(ip: Column) -> Column:
    n = ipv4_number(ip)
    return F.when(n.isNotNull(), F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _hextets(v: Column) -> Column:
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(v, ":"))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def compressed_ipv6(ip: Column) -> Column:
    """The shortest form: lower case, no leading zeros, the first longest run of zero groups as ::; null if it is none.
    A dotted tail becomes two groups; scopes are refused."""

    def plain(v: Column) -> Column:
        n = ipv4_number(F.regexp_extract(v, r"^.*:([0-9.]*\.[0-9.]*)$", 1))
        groups = F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(F.pmod(n, F.lit(65536)))))
        return F.when(~v.contains("."), v).otherwise(F.concat(F.regexp_extract(v, r"^(.*:)", 1), groups))

    def filled(halves: Column) -> Column:
        left, right = _hextets(halves[0]), _hextets(F.try_element_at(halves, F.lit(2)))
        given = F.size(left) + F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given))
        return F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (given < 8), F.concat(left, zeros, right))

    def joined(groups: Column) -> Column:
        ok = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(ok, F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"))

    def shortened(full: Column) -> Column:
        short = full
        for k in range(2, 9):  # the longest run is tested last and wins
            run = rf"^(.*?):?\b0(?::0){{{k - 1}}}\b:?(.*)$"
            short = F.when(full.rlike(run), F.regexp_replace(full, run, "$1::$2")).otherwise(short)
        return short

    text = bound(F.lower(F.trim(ip)), plain)
    return bound(bound(bound(F.split(text, "::"), filled), joined), shortened)


def net_range(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def in_nets(number: Column, nets: list[str]) -> Column:
    hit = F.lit(False)
    for cidr in nets:
        hit = hit | number.between(*net_range(cidr))
    return hit


# The same networks as patterns on the address, one test instead of a range each.
PRIVATE_PATTERN = (
    r"^(0|10|127|2[45][0-9])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\."
    r"|^192\.168\.|^192\.0\.0\.|^198\.1[89]\."
)
DOCUMENTATION_PATTERN = r"|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\."


def is_private(ip: Column, variant: str = "stdlib") -> Column:
    """Three definitions: `relay` counts documentation networks as public, `stdlib` and `intel` do not; `intel` adds multicast.

    For addresses without leading zeros; normalise others first. Null for what is no address.
    """
    pattern = PRIVATE_PATTERN + (DOCUMENTATION_PATTERN if variant != "relay" else "") + (r"|^2[23][0-9]\." if variant == "intel" else "")
    return F.when(is_ipv4(ip), ip.rlike(pattern))


def cidr_join(rows: DataFrame, number: str, nets: DataFrame, most: int = 200_000) -> DataFrame:
    """rows with every network (lo, hi, ...) that holds them.

    Networks are cut at /16 bounds so that the join is an equi-join on the upper half of the address; a table of up to
    `most` networks is broadcast, after it has been counted.
    """
    cut = nets.withColumn("_hi16", F.explode(F.sequence(F.shiftright(F.col("lo"), 16), F.shiftright(F.col("hi"), 16))))
    if cut.count() <= most:
        cut = F.broadcast(cut)
    rows = rows.withColumn("_hi16", F.shiftright(F.col(number), 16))
    return rows.join(cut, "_hi16").filter(F.col(number).between(F.col("lo"), F.col("hi"))).drop("_hi16")


def ip_analysis(ip: Column) -> Column:
    n = ipv4_number(ip)
    flag = lambda nets, name: F.when(in_nets(n, nets), F.lit(name))
    warnings = F.array_compact(F.array(
        F.when(n.isNull(), "invalid"), flag(["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"], "private"),
        flag(["127.0.0.0/8"], "loopback"), flag(["169.254.0.0/16"], "link_local"), flag(["224.0.0.0/4"], "multicast"),
        flag(["240.0.0.0/4"], "reserved"), F.when(ip == "169.254.169.254", "metadata"),
    ))
    return F.struct(n.isNotNull().alias("valid"), F.coalesce(is_private(ip), F.lit(False)).alias("is_private"), warnings.alias("warnings"))


# ---- hashes and attachments


def hash_type(h: Column) -> Column:
    return F.when(h.rlike("^[0-9a-fA-F]{32}$"), "MD5").when(h.rlike("^[0-9a-fA-F]{40}$"), "SHA1").when(h.rlike("^[0-9a-fA-F]{64}$"), "SHA256")


def extension(filename: Column) -> Column:
    base = F.element_at(F.split(text_or_empty(filename), r"[/\\]"), -1)
    return F.nullif(F.lower(F.regexp_extract(base, r"[^.]\.([^.]*)$", 1)), F.lit(""))


def double_extension(filename: Column) -> Column:
    parts = F.split(F.lower(text_or_empty(filename)), r"\.")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return (F.size(parts) >= 3) & last.isin(DANGEROUS) & before.isin(DOCUMENTS + ARCHIVES)


def mime_mismatch(content_type: Column, ext: Column) -> Column:
    kind = F.trim(F.substring_index(F.lower(text_or_empty(content_type)), ";", 1))
    wrong = F.lit(False)
    for mime, allowed in MIME_EXTENSIONS.items():
        wrong = wrong | ((kind == mime) & ~ext.isin(allowed))
    return F.coalesce(wrong & ext.isNotNull(), F.lit(False))


def attachment_analysis(filename: Column, content_type: Column, size: Column) -> Column:
    ext = extension(filename)
    known = lambda kinds: F.coalesce(ext.isin(kinds), F.lit(False))
    flags = [
        ("is_dangerous_extension", known(DANGEROUS), 0.5), ("has_double_extension", double_extension(filename), 0.4),
        ("mime_mismatch", mime_mismatch(content_type, ext), 0.2), ("is_archive", known(ARCHIVES), 0.1),
        ("is_large", size > 10 * 1024 * 1024, 0.05),
    ]
    score = sum((F.when(flag, w).otherwise(0.0) for _, flag, w in flags), F.lit(0.0))
    return F.struct(ext.alias("extension"), *[f.alias(n) for n, f, _ in flags], F.round(F.least(F.lit(1.0), score), 6).alias("risk_score"))


# ---- SimHash blocks


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_block(fp: Column, i: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))
