"""WARC archives: a writer that makes one record a page, and a reader that salvages what a damaged archive still holds.

Each record is a gzip member of its own. Of pages with equal payloads the one with the largest page_id is written as a
response; the others are revisits, which carry the HTTP header with the payload's length and digest but not the payload.

The reader walks an archive member by member and checks each: gzip checksum, version line, Content-Length, block digest.
Where a check fails but the headers of a plain record are whole, it goes on at the end that Content-Length names, if a
record that passes or the end of the archive is there; else at the next place that looks like a gzip member or a version
line. The bytes between two records that passed are one quarantined gap, logged with its reason in the same pass. Later
records are recovered; one that was found by search, and so may be the payload of the damaged one, is marked `searched`.

Edge cases: a null html is an empty payload. A null page_id is written without a number and read back as null; it is a
revisit if a page with a number has its payload, else a response. Rows that repeat the largest page_id of a payload are
all responses. A payload of any size is one record, held whole. A null url has no target line; control characters in urls are percent-encoded. Extra columns are not
read. No page gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_IDS, fresh_path, settled
from .tokenfile import file_system

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The upper half of the identifiers of records; the lower half is the page_id.
NAMESPACE = 0x6D616C70_7269736D


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _uuid(number: int) -> str:
    x = f"{NAMESPACE:016x}{number & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _number(name: str) -> int | None:
    x = name.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    if len(x) != 32 or int(x[:16], 16) != NAMESPACE:
        return None
    n = int(x[16:], 16)
    return n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str, revisit: bool) -> bytes:
    """The bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: {_uuid(page_id)}" if page_id is not None else f"WARC-Record-ID: <urn:sha1:{digest(block)}>")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}"] + [f"WARC-Refers-To: {_uuid(refers_to)}"] * (refers_to is not None)
    head += [
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member without time or name: equal records have equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes
    searched: bool = False


@dataclass
class Salvage:
    """Iterates over the records of an archive's bytes; `gaps` lists (first byte, end, reason) of what was left out."""

    data: bytes
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def __iter__(self) -> Iterator[Record]:
        at, bad, why, named, data = 0, None, "", None, self.data
        while at < len(data):
            found, reason = self._at(at)
            if found is not None:
                if bad is not None:
                    self.gaps.append((bad, at, why))
                    found.searched = at != named
                    bad = None
                yield found
                at = found.end
                continue
            if bad is None:
                bad, why = at, reason
                named = self._end(at)  # what the damaged record's own headers say
                if named is not None and (named == len(data) or self._at(named)[0] is not None):
                    at = named
                    continue
                named = None
            places = [x for x in (data.find(MEMBER, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(places, default=len(data))
        if bad is not None:
            self.gaps.append((bad, len(data), why))

    def _at(self, at: int) -> tuple[Record | None, str]:
        return self._gzip(at) if self.data.startswith(MEMBER, at) else self._plain(at)

    def _end(self, at: int) -> int | None:
        """Where a plain record ends by its headers, if these are whole and name a place in the archive."""
        if not self.data.startswith(b"WARC/1.", at) or (split := self.data.find(b"\r\n\r\n", at)) < 0:
            return None
        lengths = [x.split(b":")[1].strip() for x in self.data[at:split].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if len(lengths) != 1 or not lengths[0].isdigit():
            return None
        end = split + 8 + int(lengths[0])
        return end if end <= len(self.data) else None

    def _gzip(self, at: int) -> tuple[Record | None, str]:
        z = zlib.decompressobj(31)
        parts, step = [], 1 << 16
        try:
            for i in range(at, len(self.data), step):
                parts.append(z.decompress(self.data[i : i + step]))
                if z.eof:
                    end = min(i + step, len(self.data)) - len(z.unused_data)
                    return self._parsed(b"".join(parts), at, end)
        except zlib.error as e:
            return None, f"gzip: {e}"
        return None, "gzip: truncated member"

    def _plain(self, at: int) -> tuple[Record | None, str]:
        if not self.data.startswith(b"WARC/1.", at):
            return None, "no version line"
        end = self._end(at)
        if end is None:
            return None, "headers or Content-Length do not name an end"
        return self._parsed(self.data[at:end], at, end)

    def _parsed(self, data: bytes, at: int, end: int) -> tuple[Record | None, str]:
        if not data.startswith(b"WARC/1."):
            return None, "no version line"
        split = data.find(b"\r\n\r\n")
        if split < 0:
            return None, "no end of headers"
        lines = data[:split].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[split + 4 : -4]
        if not data.endswith(b"\r\n\r\n") or not headers.get("content-length", "").isdigit() or len(block) != int(headers["content-length"]):
            return None, "Content-Length does not match"
        said = headers.get("warc-block-digest", "")
        if said.startswith("sha1:") and said[5:] != digest(block):
            return None, "block digest does not match"
        return Record(at, end, headers, block), ""


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), refers_to (null for responses) and revisit.

    Only digests that occur more than once are joined back: broadcast if they were counted as few (some 60 bytes each),
    else by a shuffle, in which adaptive execution splits a digest that many pages share.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    big = keyed.filter(F.octet_length("payload") >= min_bytes)
    twice = big.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twice = settled(twice, "warc-responses")
    # roles are decided on narrow rows: payloads are not shuffled to them unless digests repeat beyond a broadcast
    few = twice.count() <= BROADCAST_IDS // 16
    met = keyed.join(F.broadcast(twice) if few else twice, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_bytes)
    return met.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


MANIFEST = "path string, records long, bytes long"


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes archives to the shared folder; returns their manifest. A task that is run twice leaves whole files."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, piece, held, n, out = context.partitionId(), 0, 0, 0, None

        def close() -> pd.DataFrame:
            out.close()
            fs.move(f"{name}.{context.taskAttemptId()}", name)
            return pd.DataFrame([[f"{folder}/{name.rsplit('/', 1)[1]}", n, held]], columns=["path", "records", "bytes"])

        fs, base = file_system(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"{base}/{part:06d}-{piece:04d}.warc.gz"
                    out = fs.open_output_stream(f"{name}.{context.taskAttemptId()}")
                sha1 = base64.b32encode(bytes.fromhex(row.sha1)).decode("ascii")
                number = None if row.no_id else int(row.page_id)
                to = None if row.no_ref else int(row.refers_to)
                data = member(record(number, row.url, row.payload, to, sha1, bool(row.revisit)))
                out.write(data)
                held, n = held + len(data), n + 1
                if held >= archive_bytes:
                    yield close()
                    piece, held, n, out = piece + 1, 0, 0, None
        if out is not None:
            yield close()

    rows = with_roles(pages, min_bytes).select(
        F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("no_id"), "url", "payload",
        "sha1", F.coalesce("refers_to", F.lit(0)).alias("refers_to"), F.col("refers_to").isNull().alias("no_ref"), "revisit",
    )
    return settled(rows.mapInPandas(write_part, MANIFEST), "warc-manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, searched boolean"
GAPS = "path string, first long, last long, reason string"


def salvage(manifest: DataFrame) -> DataFrame:
    """A row for each record that passes the checks and, in the same pass, for each quarantined range of bytes (reason set)."""

    def read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    archive = Salvage(f.read())  # an archive is written with a bound on its size
                rows = []
                for r in archive:
                    h = r.headers
                    head, _, payload = r.block.partition(b"\r\n\r\n")
                    revisit = h.get("warc-type") == "revisit"
                    sizes = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    rows.append((
                        _number(h.get("warc-record-id", "")), int(sizes[0]) if revisit and sizes else len(payload),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload), h.get("warc-type"),
                        _number(h.get("warc-refers-to", "")) if revisit else None, r.searched, None, None, None, None,
                    ))
                rows += [(None, None, None, None, None, None, path, *gap) for gap in archive.gaps]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out.astype({c: kind for c, kind in zip(names, kinds, strict=True) if kind == "Int64"})

    fields = [x.split() for x in f"{RECORDS}, {GAPS}".split(", ")]
    names, kinds = [x[0] for x in fields], ["Int64" if x[1] == "long" else "object" for x in fields]
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(n).mapInPandas(read_part, f"{RECORDS}, {GAPS}")


def read(manifest: DataFrame) -> DataFrame:
    """The records, once all archives are read; gaps are logged, by archive."""
    found = settled(salvage(manifest), "warc-records")
    lost = found.filter("reason is not null").groupBy("path").agg(F.count(F.lit(1)).alias("gaps"), F.sum(F.col("last") - F.col("first")).alias("bytes"))
    for x in lost.orderBy(F.desc("bytes"), "path").limit(20).collect():  # the largest; gaps() has all
        logging.getLogger(__name__).warning("%s: %d gaps, %d bytes", x["path"], x["gaps"], x["bytes"])
    return found.filter("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def gaps(manifest: DataFrame) -> DataFrame:
    """path, first, last (excluded) and reason of each quarantined range of bytes."""
    return salvage(manifest).filter("reason is not null").select("path", "first", "last", "reason")
