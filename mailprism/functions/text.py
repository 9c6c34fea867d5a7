"""Text functions as Column builders; all but NFKC, entity and HTML-parser variants stay in the JVM."""

from __future__ import annotations

import html
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Controls that carry no text (zero width, byte order mark, bidirectional marks).
INVISIBLE = "\u200b\u200c\u200d\ufeff\u202a\u202b\u202c\u202d\u202e"

# Wording of business e-mail compromise and phishing, by lexicon.
LEXICONS = {
    "urgency_score": ["urgent", "immediately", "action required", "within 24 hours", "suspended", "deadline", "expire[ds]?", "critical", "act now", "final notice", "immediate response"],
    "credential_harvest_cues": ["verify your account", "confirm password", "update payment", "security alert", "unauthorized access", "log in to verify", "reset password", "security notice", "unusual activity"],
    "payment_request_cues": ["wire transfer", "bank account", "invoice attached", "remittance", "payment details", "gift card", "routing number", "direct deposit", "new account details"],
    "account_verification_cues": ["verify", "verification", "confirm your identity", "validate", "reactivate", "account suspended", "security update", "confirm details"],
    "secrecy_cues": ["confidential", "keep this between us", "do not contact", "private matter", "discreet", "strictly confidential", "urgent and confidential"],
    "bank_change_cues": ["updated bank", "new banking details", "change of account", "beneficiary change", "new bank", "updated account number", "wire instructions"],
    "gift_card_cues": ["itunes", "google play", "steam card", "gift card", "apple card", "amazon gift", "ebay card"],
    "wire_transfer_cues": ["wire", "swift", "iban", "wire transfer", "routing number", "ach transfer"],
    "invoice_cues": ["invoice", "receipt", "purchase order", "overdue", "statement", "billing statement", "unpaid"],
    "executive_terms_count": ["ceo", "cfo", "cto", "cio", "president", "director", "executive", "board", "partner"],
    "login_terms_count": ["login", "sign in", "log in", "portal", "credentials", "sign-in", "log-in"],
    "password_terms_count": ["password", "passcode", "pin", "mfa", "2fa", "otp", "security token"],
}

# Presence patterns of the risk engine.
URGENCY = r"(?i)\b(urgent|immediately|action required|suspended|final notice|account locked|unauthorized access|security alert|act now|limited time|expire|deadline)\b"
CREDENTIAL = r"(?i)\b(password|passcode|credential|login|sign in|signin|verify your account|confirm your identity|security code|otp|pin number|ssn|social security)\b"
PAYMENT = r"(?i)\b(wire transfer|bank transfer|direct deposit|remittance|invoice attached|payment due|bank details|routing number|swift code|gift card|bitcoin|crypto|usdt)\b"

# What hides text in HTML.
HIDDEN_TEXT = (
    r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0\b|color\s*:\s*rgba?\([^)]+,\s*0\)|"
    r"color\s*:\s*(#fff|#ffffff|white)\s*;[^\>]*background(?:-color)?\s*:\s*(#fff|#ffffff|white))"
)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count_of(c: Column, pattern: str) -> Column:
    """Matches of a pattern as double; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("double")


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\u0000"), F.lit("�"))


def without_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition: Spark has no builtin for it."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return s.map(html.unescape, na_action="ignore")


class _Reader(HTMLParser):
    silent = ("script", "style", "head")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.text, self.links = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.silent:
            self.depth += 1
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]
        self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent and self.depth:
            self.depth -= 1
        self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.text.append(data)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]))
def parsed_html(s: pd.Series) -> pd.DataFrame:
    """Visible text and hrefs by a real parser."""
    rows = []
    for x in s:
        r = _Reader()
        r.feed(x or "")
        r.close()
        rows.append((" ".join("".join(r.text).split()), r.links))
    return pd.DataFrame(rows, columns=["text", "links"])


def html_text(c: Column) -> Column:
    """Visible text by patterns alone: silent elements and tags become spaces, white space is squeezed."""
    c = F.regexp_replace(c, r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t\r\n\f]+", " "))


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))


def squeezed(c: Column) -> Column:
    """Runs of blanks as one, three or more line ends as two, trimmed."""
    c = F.regexp_replace(c, r"[ \t\f]+", " ")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalized_body(c: Column) -> Column:
    """NUL, compatibility forms, invisible controls, white space."""
    return squeezed(without_invisible(nfkc(without_nul(c))))


def content_hash(subject: Column, body: Column) -> Column:
    """SHA-256 of subject and body with white space squeezed and case dropped."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(text_or_empty(c), r"[ \t\r\n\f]+", " ")))
    return F.sha2(F.concat_ws("\n", flat(subject), flat(body)), 256)


def masked(c: Column) -> Column:
    """Semantic cleaner: script and style gone, tags as spaces, URL, address, money and phone as marks."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"(?i)(https?://[^ \t\r\n<>]+|www\.[^ \t\r\n<>]+)", "[URL]")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    c = F.regexp_replace(c, r"[$€£¥][ ]?[0-9][0-9,]*(\.[0-9]+)?", "[MONEY]")
    c = F.regexp_replace(c, r"\+?[0-9]{1,3}[-. ][0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}", "[PHONE]")
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def formatted(subject: Column, body: Column) -> Column:
    some = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("[EMPTY]"))
    return F.concat(F.lit("[SUBJECT] "), some(subject), F.lit(" [BODY] "), some(body))


def head_tail(tokens: Column, most: int) -> Column:
    """The first and the last halves of a token array that is longer than `most`."""
    head = most // 2
    return F.when(F.size(tokens) <= most, tokens).otherwise(
        F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(most - head), most - head))
    )


def lexicon_count(c: Column, terms: list[str]) -> Column:
    """Matches of each term as words, case aside, summed: a word in two terms counts twice."""
    total = F.lit(0.0)
    for term in terms:
        total = total + count_of(c, rf"(?i)\b{term}\b")
    # one test spares the texts without any of the terms all the others
    return F.when(c.rlike(rf"(?i)\b({'|'.join(terms)})\b"), total).otherwise(0.0)


def keyword_signal(c: Column, terms: list[str], each: float = 0.25) -> Column:
    """Capped linear score."""
    return F.least(F.lit(1.0), lexicon_count(c, terms) * each)


def share_of(c: Column, pattern: str) -> Column:
    """Characters of a class over all characters; 0 for empty."""
    return F.when(F.length(c) > 0, count_of(c, pattern) / F.length(c)).otherwise(0.0)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits over the characters of a string; 0 for empty."""
    chars = F.filter(F.split(text_or_empty(c), ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    term = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc - term(ch) * F.log2(term(ch)))
    return F.when(n > 0, total).otherwise(0.0)


def domain_entropy(c: Column) -> Column:
    """The variant without dots and hyphens, lower-cased."""
    return entropy(F.lower(F.translate(text_or_empty(c), ".-", "")))


def iso(ts: Column) -> Column:
    """ISO 8601 without offset: seconds, and microseconds where there are any. Instants are given in the session's zone."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def word_count(c: Column) -> Column:
    """Runs of word characters in any script."""
    return count_of(c, r"(?U)\w+")


def blank_words(c: Column) -> Column:
    """Pieces between white space."""
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+"))).cast("double")


def line_count(c: Column) -> Column:
    """Lines as a reader of text lines counts them: a final line end opens no further line."""
    ends = count_of(c, r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85  ]")
    open_ = F.when((F.length(c) > 0) & ~c.rlike(r"(?s)[\n\r\x0b\f\x1c\x1d\x1e\x85  ]\z"), 1.0).otherwise(0.0)
    return ends + open_


def repeated_character(c: Column) -> Column:
    return text_or_empty(c).rlike(r"(.)\1{3,}")
