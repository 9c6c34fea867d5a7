"""Token-id files: ids back to back, document boundaries and document ids in Elias-Fano form.

A file is
    magic "MPTOK1\\0\\0", then little-endian uint64: version of the id width in bytes (2 or 4), documents, documents
    without doc_id (they come first), ids, smallest doc_id as a signed 64-bit integer, and the lengths in bytes of the
    three sections that follow;
    the ids; the Elias-Fano code of the documents + 1 boundaries; the Elias-Fano code of doc_id - smallest.
An Elias-Fano code of n values up to u takes about 2 + log2(u / n) bits a value: the low bits packed, the high bits in
unary, and, stored with them, the position of every 256th one as a sample for select. Readers find offsets by select;
no list of all of them is made.

Shards are written in ascending doc_id order by range partitions, so that the ids before a document are those of the
shards before it plus its boundary. A shard is written under another name and renamed: a task that is run twice leaves
one whole file.

Edge cases: a null or empty text has the end id alone. Rows without doc_id come first and keep their texts. Rows that
repeat a doc_id follow each other, ordered by text; many of them are parted by the first letters of their texts. A text
of any length is encoded whole, a few MB of texts or one longer text at a time. The strings of special tokens in a text
become their ids, as is the library's default. Extra columns are not read. No document gives no shard.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from .columns import few_mb, worker_cache
from .common import fresh_path, settled

MAGIC = b"MPTOK1\0\0"
HEADER = struct.Struct("<8sQQQQqQQQ")
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space, with access to any one of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.samples = samples  # positions of every SAMPLE-th one

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        ratio = int(values[-1]) // n
        k = max(0, ratio.bit_length() - 1)
        bits = (values[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1) if k else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, k, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQ", self.n, self.low_bits, len(self.samples), len(self.low))
        return head + self.samples.astype("<u8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, k, samples, low = struct.unpack_from("<QQQQ", data)
        at = struct.calcsize("<QQQQ")
        marks, at = np.frombuffer(data, "<u8", samples, at), at + 8 * samples
        return cls(n, k, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, -1, at + low), marks)

    def _select(self, i: int) -> int:
        """Position of the i-th one: from its sample on, bytes are skipped by their count of ones."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, bit = divmod(at, 8)
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        k, low = self.low_bits, 0
        if k:
            first, last = i * k // 8, (i * k + k - 1) // 8
            word = int.from_bytes(self.low[first : last + 1].tobytes(), "little")
            low = word >> (i * k % 8) & ((1 << k) - 1)
        return (self._select(i) - i) << k | low

    def values(self, first: int, last: int) -> np.ndarray:
        """Values number first to last, last excluded: select finds the ends, and only what lies between is unpacked."""
        if first >= last:
            return np.zeros(0, np.uint64)
        a, b, k = self._select(first), self._select(last - 1), self.low_bits
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : b // 8 + 1], bitorder="little")) + a // 8 * 8
        ones = ones[(ones >= a) & (ones <= b)]
        high = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(k)
        if not k:
            return high
        bits = np.unpackbits(self.low[first * k // 8 : -(-last * k // 8)], bitorder="little")[first * k % 8 :]
        bits = bits[: (last - first) * k].reshape(last - first, k).astype(np.uint64)
        return high | (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


def write_shard(uri: str, attempt: str, ids: list[bytes], doc_ids: list[int | None], width: int) -> int:
    """Writes one file from each document's ids (already `width` bytes each); returns its count of ids."""
    counts = np.array([len(x) // width for x in ids], dtype=np.int64)
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(counts)])).to_bytes()
    known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    names = EliasFano.encode((known - base).view(np.uint64) if len(known) else known).to_bytes()
    total = int(counts.sum())
    head = HEADER.pack(
        MAGIC, width, len(ids), len(ids) - len(known), total, base, total * width, len(bounds), len(names)
    )
    fs, path = file_system(uri)
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        out.write(head)
        for x in ids:
            out.write(x)
        out.write(bounds)
        out.write(names)
    fs.move(f"{path}.{attempt}", path)
    return total


class TokenFile:
    """A shard opened for reading; ids are read by range, never as a whole."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        magic, self.width, self.n, self.n_null, self.total, self.base, size, bounds, names = HEADER.unpack(
            self.file.read_at(HEADER.size, 0)
        )
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, HEADER.size + size))
        self.names = EliasFano.from_bytes(self.file.read_at(names, HEADER.size + size + bounds))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.names[i - self.n_null]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number first to last of the file, last excluded, as uint32."""
        data = self.file.read_at((last - first) * self.width, HEADER.size + first * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])


#: Words of small Latin-1 letters: neither normaliser nor pre-tokeniser changes or cuts them, so that the library's
#: merges can be asked directly.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


#: The rules of a tokenizer file under which texts may be taken in pieces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed", "invert": True,
}


class WordCache:
    """Ids of whole texts by the tokenizers library, which is asked once for each piece between white space.

    The vocabulary's normaliser turns runs of white space into one space and lowers case, and its pre-tokeniser drops
    white space and parts letters from marks, so that no token spans these bounds and the pieces' ids in a row are those
    of the text. Only a file with such rules is taken in pieces; texts of any other are encoded whole.
    """

    #: Marks that may be parted from a word that they end; an apostrophe is not one, for it can begin a token with letters.
    MARKS = ".,;:!?#$%&*|"

    def __init__(self, rules: str, end_id: int, max_cached: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(rules)
        self.end_id, self.width = end_id, 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        self.code, self.dtype = "H" if self.width == 2 else "I", np.dtype(f"<u{self.width}")
        self.end = self._pack([end_id])
        self.max_cached, self.parts, self.older = max_cached, {}, {}
        # the characters that stand for the bytes of a letter: printable Latin-1 ones for themselves, the others above
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        name = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_names = {c: "".join(name[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
        parsed = json.loads(rules)
        special = [t["content"] for t in parsed["added_tokens"]]
        self.special = "|".join(re.escape(t.lower()) for t in special)
        steps = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.splits = (
            (parsed["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(steps) == 2 and steps[0] == SPLIT
            and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
            and not any(x.isspace() or ord(x) > 126 for t in special for x in t)
        )

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _parted(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(core, marks) of distinct words: the marks that end a word, if a letter or digit stands before them."""
        # a special token stands for itself in the text as it is; words that hold one in any case are left to the library
        plain = pc.invert(pc.match_substring_regex(words, self.special, ignore_case=True)) if self.special else pa.array([True] * len(words))
        cut = pc.utf8_rtrim(words, self.MARKS)
        parts = pc.and_(pc.match_substring_regex(cut, "[A-Za-z0-9]$"), pc.less(pc.binary_length(cut), pc.binary_length(words)))
        parts = pc.and_(parts, plain)
        marks = pc.replace_substring_regex(words.filter(parts), f"^.*[^{re.escape(self.MARKS)}]", "")
        core = pc.if_else(parts, cut, words)
        core = pc.if_else(pc.and_(pc.string_is_ascii(core), plain), pc.ascii_lower(core), core)
        return core, pc.replace_with_mask(pa.array([""] * len(words), words.type), parts, marks)

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The packed ids of distinct parts, from two generations of cached ones or else the library."""
        got = list(map(self.parts.get, parts))
        older, new = self.older, []
        for i in [i for i, x in enumerate(got) if x is None]:
            got[i] = older.get(parts[i])
            if got[i] is None:
                new.append(i)
        rest, merges, plain, names = [], self.tokenizer.model.tokenize, PLAIN.fullmatch, self.byte_names
        for i in new:
            if plain(parts[i]):
                got[i] = array(self.code, [t.id for t in merges(parts[i].translate(names))]).tobytes()
            else:
                rest.append(i)
        batch = self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, batch, strict=True):
            got[i] = array(self.code, e.ids).tobytes()
        self.parts.update(zip(parts, got, strict=True))
        if len(self.parts) > self.max_cached:
            self.parts, self.older = {}, {k: v for k, v in self.parts.items() if len(k) <= 64}
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text with the end id last, back to back, and the bounds of the texts in them.

        Words are told apart in columns; Python sees each distinct word of the array once. Pass a few MB at most.
        """
        texts = pc.fill_null(texts, "")
        if not self.splits:
            runs = [e.ids + [self.end_id] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            flat = np.array([i for run in runs for i in run], dtype=self.dtype)
            return flat, np.concatenate([[0], np.cumsum([len(run) for run in runs])]).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts)  # at the ASCII spaces alone, each one of \\s
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        core, marks = self._parted(coded.dictionary)
        parts = pa.concat_arrays([core, marks]).dictionary_encode()
        ids = self._ids(parts.dictionary.to_pylist())
        of = np.asarray(parts.indices).reshape(2, -1)
        packed = list(map(ids.__getitem__, of[0].tolist()))
        for i in np.flatnonzero(np.asarray(pc.binary_length(marks))).tolist():
            packed[i] += ids[of[1, i]]
        table = np.frombuffer(b"".join(packed) + self.end, dtype=self.dtype)
        lengths = np.append(np.fromiter(map(len, packed), np.int32, len(packed)) // self.width, np.int32(1))
        firsts = np.cumsum(lengths, dtype=np.int32) - lengths
        # one more word, the end id, after the words of each text
        words = np.insert(np.asarray(coded.indices), bounds[1:], len(packed))
        each = lengths[words]
        ends = np.cumsum(each, dtype=np.int32)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat(firsts[words] - (ends - each), each)
        stops = ends[bounds[1:] + np.arange(len(texts))].astype(np.int64)
        return table[at], np.concatenate([[0], stops])


MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, tokenizer_file: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes the shards to the shared folder and returns their manifest: shard, path, n_docs, n_ids, start.

    The tokenizer file is read on the driver and sent to the executors; its size is that of the vocabulary.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        rules = spark.sparkContext.broadcast(f.read())
    folder = fresh_path(spark, "tokens")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    key = ("words", tokenizer_file, end_id)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        context = TaskContext.get()
        cache = worker_cache(key, lambda: WordCache(rules.value, end_id))
        part, piece, ids, doc_ids, held = context.partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{part:06d}-{piece:04d}.tok"
            total = write_shard(uri, f"{context.taskAttemptId()}", ids, doc_ids, cache.width)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([part], pa.int32()), "path": [uri], "n_docs": [len(ids)], "n_ids": [total]}
            )

        for batch in batches:
            for some in few_mb(batch, 4 << 20):
                flat, bounds = cache.encode(some.column("text"))
                for doc_id, first, last in zip(some.column("doc_id").to_pylist(), bounds, bounds[1:]):
                    ids.append(flat[first:last].tobytes())
                    doc_ids.append(doc_id)
                    held += len(ids[-1])
                if held > 48 << 20:  # a shard is held in memory until it is written
                    yield close()
                    piece, ids, doc_ids, held = piece + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")  # nulls first
    written = settled(parts.mapInArrow(write_part, MANIFEST), "token-manifest")
    # one row for each shard of up to 64 MB of ids: the only list that is brought together
    manifest = sorted(written.collect(), key=lambda r: r["path"])
    starts = np.concatenate([[0], np.cumsum([r["n_ids"] for r in manifest])]) if manifest else [0]
    return spark.createDataFrame(
        [(*r, int(s)) for r, s in zip(manifest, starts)], f"{MANIFEST}, start long"
    )


def read(manifest: DataFrame, files_a_task: int = 4) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, ids_crc32."""

    def read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                shard = TokenFile(path)
                for at in range(0, shard.n, 1000):
                    to = min(shard.n, at + 1000)
                    bounds = shard.bounds.values(at, to + 1).astype(np.int64)
                    known = max(0, shard.n_null - at)
                    names = shard.names.values(max(0, at - shard.n_null), max(0, to - shard.n_null)).view(np.int64) + shard.base
                    doc_ids = [None] * min(known, to - at) + names.tolist()
                    ids = shard.ids(int(bounds[0]), int(bounds[-1]))
                    cuts = bounds - bounds[0]
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                    yield pd.DataFrame({
                        "doc_id": pd.array(doc_ids, dtype="Int64"), "start": bounds[:-1] + start,
                        "n_tokens": np.diff(cuts), "ids_crc32": crc,
                    })

    n = max(1, manifest.count() // files_a_task)
    parts = manifest.select("path", "start").repartition(n)
    return parts.mapInPandas(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")
