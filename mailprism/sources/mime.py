"""Raw mail: scan, parse, fan out. Parsing is the one place where a Python UDF has no builtin to yield to."""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
from collections.abc import Iterator
from datetime import UTC
from email.header import decode_header, make_header
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MOST_BYTES = 10 << 20

_S = T.StringType
_ADDRESS = T.StructType([T.StructField("name", _S()), T.StructField("address", _S())])
_HEADER = T.StructType([T.StructField("name", _S()), T.StructField("value", _S()), T.StructField("position", T.IntegerType())])
_ATTACHMENT = T.StructType([
    T.StructField("filename", _S()), T.StructField("content_type", _S()), T.StructField("size", T.LongType()),
    T.StructField("sha256", _S()), T.StructField("content", T.BinaryType()),
])
MAIL = T.StructType([
    T.StructField("raw_sha256", _S()), T.StructField("raw_size", T.LongType()), T.StructField("subject", _S()), T.StructField("sender", _S()),
    T.StructField("sender_name", _S()), T.StructField("reply_to", _S()), T.StructField("to", T.ArrayType(_ADDRESS)), T.StructField("cc", T.ArrayType(_ADDRESS)),
    T.StructField("message_id", _S()), T.StructField("date", T.TimestampType()), T.StructField("body_text", _S()), T.StructField("body_html", _S()),
    T.StructField("headers", T.ArrayType(_HEADER)), T.StructField("attachments", T.ArrayType(_ATTACHMENT)),
])


def _clean(x: str | None) -> str | None:
    return None if x is None else str(x).replace("\x00", "�")


def _decoded(x) -> str | None:
    if x is None:
        return None
    try:
        return _clean(str(make_header(decode_header(str(x)))))
    except (LookupError, UnicodeError, ValueError):
        return _clean(str(x))


def _addresses(msg: Message, name: str) -> list[dict]:
    values = [str(v) for v in msg.get_all(name, [])]
    return [{"name": _decoded(n) or "", "address": a} for n, a in email.utils.getaddresses(values) if a]


def _text(part: Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return _clean(data.decode(part.get_content_charset() or "utf-8", "replace")) or ""
    except LookupError:
        return _clean(data.decode("utf-8", "replace")) or ""


def _walk(msg: Message, found: dict, inside: bool = False) -> None:
    kind, disposition = msg.get_content_type(), msg.get_content_disposition()
    if kind == "message/rfc822":
        inner = msg.get_payload()
        inner = inner[0] if isinstance(inner, list) and inner else None
        data = inner.as_bytes() if inner is not None else b""
        found["attachments"].append((msg.get_filename() or "attached.eml", kind, data))
        return
    if msg.is_multipart():
        for part in msg.get_payload():
            _walk(part, found, True)
        return
    name = _decoded(msg.get_filename())
    if disposition == "attachment" or name:
        found["attachments"].append((name, kind, msg.get_payload(decode=True) or b""))
    elif kind == "text/plain" and found["text"] is None:
        found["text"] = _text(msg)
    elif kind == "text/html" and found["html"] is None:
        found["html"] = _text(msg)
    elif inside and not kind.startswith("text/"):
        found["attachments"].append((name, kind, msg.get_payload(decode=True) or b""))


def parse(raw: bytes) -> dict:
    """One message; what cannot be read at all is named so and keeps its hash."""
    out = {f.name: None for f in MAIL.fields} | {"raw_sha256": hashlib.sha256(raw).hexdigest(), "raw_size": len(raw), "to": [], "cc": [], "headers": [], "attachments": []}
    try:
        try:
            msg = email.message_from_bytes(raw, policy=email.policy.default)
            msg.items()
        except Exception:  # headers that the modern policy rejects
            msg = email.message_from_bytes(raw, policy=email.policy.compat32)
        name, address = email.utils.parseaddr(str(msg.get("From", "")))
        date = None
        try:
            date = email.utils.parsedate_to_datetime(str(msg["Date"])) if msg["Date"] else None
            date = date.replace(tzinfo=UTC) if date is not None and date.tzinfo is None else date
        except (TypeError, ValueError):
            pass
        found: dict = {"text": None, "html": None, "attachments": []}
        _walk(msg, found)
        out |= {
            "subject": _decoded(msg.get("Subject")), "sender": address or None, "sender_name": _decoded(name) or None,
            "reply_to": email.utils.parseaddr(str(msg.get("Reply-To", "")))[1] or None, "to": _addresses(msg, "To"), "cc": _addresses(msg, "Cc"),
            "message_id": _clean(msg.get("Message-ID")), "date": date, "body_text": found["text"], "body_html": found["html"],
            "headers": [{"name": k, "value": _decoded(v), "position": i} for i, (k, v) in enumerate(msg.items())],
            "attachments": [{"filename": n, "content_type": k, "size": len(c), "sha256": hashlib.sha256(c).hexdigest(), "content": c} for n, k, c in found["attachments"]],
        }
    except Exception:  # no input may end a job over millions of messages
        out["subject"] = "(Unparseable Email)"
    return out


@F.pandas_udf(MAIL)
def parsed(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in raw:
        yield pd.DataFrame([parse(bytes(x)) if x is not None else {f.name: None for f in MAIL.fields} for x in batch], columns=MAIL.names)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(folder)
    return files.filter(~F.element_at(F.split("path", "/"), -1).startswith("."))


def scan(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, size, content) of .eml files under a folder, dot files aside; `rejects` has those that are too large."""
    return _files(spark, folder).filter(F.col("length") <= most_bytes).select("path", F.col("length").alias("size"), "content")


def rejects(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, size, reason) of the files that scan leaves out; their content is not read."""
    too_large = _files(spark, folder).filter(F.col("length") > most_bytes)
    return too_large.select("path", F.col("length").alias("size"), F.lit("too large").alias("reason"))


def mails(raw: DataFrame) -> DataFrame:
    """path and the parsed message; the raw hash is taken in the JVM, before any parsing."""
    return raw.select("path", F.sha2("content", 256).alias("evidence_sha256"), parsed("content").alias("m")).select("path", "evidence_sha256", "m.*")


def header_rows(mail: DataFrame) -> DataFrame:
    return mail.select("path", F.explode("headers").alias("h")).select("path", "h.*")


def header_map(mail: DataFrame) -> DataFrame:
    """Lower-case header names with all their values in order."""
    h = F.transform("headers", lambda x: F.struct(F.lower(x["name"]).alias("k"), x["value"].alias("v")))
    names = F.array_distinct(F.transform(h, lambda x: x["k"]))
    return mail.select("path", F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.transform(F.filter(h, lambda x: x["k"] == k), lambda x: x["v"])))).alias("headers"))


def attachment_rows(mail: DataFrame) -> DataFrame:
    return mail.select("path", F.explode("attachments").alias("a")).select("path", "a.*")


def write_tables(mail: DataFrame, folder: str) -> None:
    """Fans a parsed frame out to messages, raw hashes, headers and attachments."""
    mail.drop("headers", "attachments", "evidence_sha256").write.mode("append").parquet(f"{folder}/emails")
    mail.select("path", "evidence_sha256").write.mode("append").parquet(f"{folder}/raw_hashes")
    header_rows(mail).write.mode("append").parquet(f"{folder}/headers")
    attachment_rows(mail).write.mode("append").parquet(f"{folder}/attachments")


def stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """Messages as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return mails(raw.filter(F.col("length") <= MOST_BYTES).select("path", F.col("length").alias("size"), "content"))
