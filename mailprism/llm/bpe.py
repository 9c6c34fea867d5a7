"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode by a UTF-8 state machine.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours stay apart when their bytes alone
are merged. So the tokens are the states of a nondeterministic transducer in which token b may follow token a if the pair
is stable. `Transducer` determinises it as it reads: a state is the set of live readings, each the last token and the bytes
of a token begun after it; a transition yields the token that ends at its byte. Transitions are kept by (state, byte) and
shared by all later texts.

At most one token ends at a byte, so the tokens before the live readings form a tree; what lies before their last common
ancestor is settled and emitted. How far that ancestor lies behind is a property of the vocabulary: it is bounded if all
readings of a long run come together after a bounded number of bytes, as they do here for runs of one or two letters, of
spaces and of CJK. A vocabulary in which two readings of an endless run never meet would hold that run back until its
match ends; `stream` tells how many bytes it holds.

Text is first cut by a pattern; each match is encoded separately. A match that is itself in the vocabulary is that one
token, even if no merges lead to it. Where the pattern lets a match hold a space only at its start, texts fall apart at
spaces that a word follows, and Python meets each distinct word of a few MB once.

Edge cases: a null text counts as empty; an empty text has no tokens. Ranks must hold all 256 single bytes. Repeated
rows are encoded one by one; extra columns are not read. Memory does not grow with the input: caches are emptied at a
fixed size. A text of over 16 MB is cut and encoded in runs of a fixed number of matches; decoding goes by blocks of a
fixed number of tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from .columns import few_mb, worker_cache


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain BPE: merges the leftmost adjacent pair of the lowest rank until none ranks below `below`."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        best = min(found)
        if best >= below:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Encodes byte strings; states and transitions are made when first met."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = 400_000) -> None:  # some 200 bytes each
        self.ranks, self.max_transitions = ranks, max_transitions
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.stable: dict[tuple[bytes | None, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple[tuple[bytes | None, bytes], ...]] = []
        self.next: list[dict[int, tuple[dict, bytes | None]]] = []  # of each state; its own number is at -1
        self.transitions = 0
        if len(self.stable) > 4 * self.max_transitions:
            self.stable.clear()
        self._state(((None, b""),))

    def _state(self, readings: tuple) -> int:
        found = self.names.get(readings)
        if found is None:
            found = self.names[readings] = len(self.states)
            self.states.append(readings)
            self.next.append({-1: found})
        return found

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """What the last merge that makes this token joins; None for a single byte or a token that no merges reach."""
        if token not in self.halves:
            own = self.ranks[token]
            parts = merge(token, self.ranks, own)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether merging the bytes of a and b alone leaves them apart, each whole.

        Undoes the merges next to the boundary, latest first; at each point a join across it must rank no better than
        the merge just undone (as good, if that one lies to the left, for the leftmost pair goes first).
        """
        found = self.stable.get((a, b))
        if found is None:
            found = self.stable[a, b] = (len(b) == 1 or self._halves(b) is not None) and (
                a is None or self._apart(a, b)
            )
        return found

    def _apart(self, left: bytes, right: bytes) -> bool:
        ranks, limit = self.ranks, 1 << 62
        while True:
            if ranks.get(left + right, 1 << 62) < limit:
                return False
            by_left, by_right = self._halves(left), self._halves(right)
            if by_left and (not by_right or ranks[left] > ranks[right]):
                limit, left = ranks[left], by_left[1]
            elif by_right:
                limit, right = ranks[right] + 1, by_right[0]
            else:
                return True

    def _step(self, node: dict, byte: int) -> tuple[dict, bytes | None]:
        """The state after a byte, and the token that ends there: at most one, for a text has one encoding."""
        state = node[-1]
        ranks, prefixes, stable = self.ranks, self.prefixes, self.stable
        live, done = [], None
        for before, begun in self.states[state]:
            begun += _BYTES[byte]
            if begun in prefixes:
                live.append((before, begun))
            if done is None and begun in ranks:
                fits = stable.get((before, begun))
                if fits or fits is None and self._follows(before, begun):
                    done = begun
        if done is not None:
            live.append((done, b""))
        found = node[byte] = self.next[self._state(tuple(live))], done
        self.transitions += 1
        return found

    def stream(self, piece: bytes, every: int = 64) -> Iterator[tuple[list[bytes], int]]:
        """(tokens settled, bytes held back), once in every `every` bytes and at the end."""
        node, ends, began = self.next[0], [], 0
        for byte in piece:
            node, done = node.get(byte) or self._step(node, byte)
            ends.append(done)
            if len(ends) >= began + 2 * every:
                at = self._settled(ends, node[-1])
                if at:
                    tokens, ends = self._back(ends, at), ends[at:]
                    yield tokens, len(ends)
                began = len(ends)
        yield self._back(ends, len(ends)), 0

    def _settled(self, ends: list[bytes | None], state: int) -> int:
        """The last place that all live readings have passed."""
        places = {len(ends) - len(begun) for _, begun in self.states[state]}
        while len(places) > 1:  # the latest one gives way to its predecessor
            at = max(places)
            places.remove(at)
            places.add(at - len(ends[at - 1]))
        return max(places, default=0)

    def encode(self, piece: bytes) -> list[bytes]:
        """The tokens of one match."""
        if piece in self.ranks:
            return [piece]
        if self.transitions > self.max_transitions:
            self._clear()
        if len(piece) > 128:
            return [t for tokens, _ in self.stream(piece) for t in tokens]
        node, ends = self.next[0], []
        for byte in piece:
            node, done = node.get(byte) or self._step(node, byte)
            ends.append(done)
        return self._back(ends, len(ends))

    @staticmethod
    def _back(ends: list[bytes | None], at: int) -> list[bytes]:
        found = []
        while at and (token := ends[at - 1]) is not None:
            found.append(token)
            at -= len(token)
        return found[::-1]


_BYTES = [bytes((i,)) for i in range(256)]


class Utf8Stream:
    """Incremental UTF-8: feed() takes any cut of the bytes and returns the characters completed so far.

    The machine counts the continuation bytes still due at the end of what it has read; those stay behind. Bytes that
    are no UTF-8 come out as U+FFFD.
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def due(tail: bytes) -> int:
        """How many bytes at the end of tail begin a character that is not complete."""
        for back in range(1, min(3, len(tail)) + 1):
            lead = tail[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if need > back else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        keep = 0 if last else self.due(data[-3:])
        self.rest = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")


#: Parts of a pattern none of whose matches holds a space but at its start, or in a run that no word follows.
_SPACE_FIRST = regex.compile(r"'[a-z]+| \?\\p\{[LN]\}\+| \?\[\^\\s\\p\{L\}\\p\{N\}\]\+|\\s\+\(\?!\\S\)|\\s\+")
_SPACE = regex.compile(r"\s")


class Codec:
    """Encodes and decodes whole texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_cached: int = 300_000, run: int = 1 << 16, long: int = 16 << 20) -> None:
        self.transducer, self.pattern = Transducer(ranks, max(1000, max_cached * 4 // 3)), regex.compile(pattern)
        self.max_cached, self.run, self.long = max_cached, run, long
        self.spaced = all(_SPACE_FIRST.fullmatch(part) for part in pattern.split("|"))
        self.of = {t: np.uint32(i).astype("<u4").tobytes() for t, i in ranks.items()}
        ordered = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            ordered[i] = t
        self.sizes = np.fromiter(map(len, ordered), np.int64, len(ordered))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.cache: dict[str, bytes] = {}  # of matches
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = b"".join([self.of[t] for t in self.transducer.encode(piece.encode("utf-8", "surrogatepass"))])
        if len(piece) <= 64:
            self.cache[piece] = found
        return found

    def _aged(self) -> None:
        if len(self.cache) > self.max_cached:
            self.cache, self.older = {}, self.cache

    def runs(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in runs of at most `run` matches."""
        if len(text) < 4 * self.run:
            yield self._join(self.pattern.findall(text))
            return
        pieces = []
        for m in self.pattern.finditer(text):
            pieces.append(m.group())
            if len(pieces) == self.run:
                yield self._join(pieces)
                pieces = []
        yield self._join(pieces)

    def _join(self, pieces: list[str]) -> bytes:
        got = list(map(self.cache.get, pieces))
        if None in got:
            got = [self._piece(p) if x is None else x for x, p in zip(got, pieces, strict=True)]
            self._aged()
        return b"".join(got)

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; of those with several matches only the matches are kept."""
        got, now, cut, piece = list(map(self.cache.get, words)), self.cache, self.pattern.findall, self._piece
        for i in [i for i, x in enumerate(got) if x is None]:
            pieces = cut(words[i])
            if len(pieces) == 1:
                got[i] = piece(words[i])
            else:
                found = list(map(now.get, pieces))
                got[i] = b"".join([piece(p) if x is None else x for x, p in zip(found, pieces, strict=True)])
        self._aged()
        return got

    def encode(self, texts: pa.Array) -> Iterator[Iterable[bytes]]:
        """The runs of ids of each text. Pass a few MB, or one text."""
        texts = pc.fill_null(texts, "")
        if not self.spaced or len(texts) == 1 and len(texts[0].as_py()) > self.long:
            yield from map(self.runs, texts.to_pylist())
            return
        lists = pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds, codes = bounds - bounds[0], np.asarray(coded.indices, dtype=np.int64)
        seen = coded.dictionary.to_pylist()
        # a space before what is no word, such as another space, is no place to cut
        begin = pc.utf8_slice_codeunits(coded.dictionary, 0, 1).dictionary_encode()
        cuts = [bool(w) and not w.isspace() and not _SPACE.match(w) for w in begin.dictionary.to_pylist()]
        cuts = np.array(cuts, bool)[np.asarray(begin.indices)]
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        whole = np.concatenate([[0], np.cumsum(~(cuts[codes] | first))])
        whole = whole[bounds[1:]] == whole[bounds[:-1]]
        kinds, codes = np.unique(np.where(first, codes, codes + len(seen)), return_inverse=True)
        packed = self._words([seen[k] if k < len(seen) else " " + seen[k - len(seen)] for k in kinds.tolist()])
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), "<u4")
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - each), each)]
        stops = np.concatenate([[0], ends])[bounds]
        for i, good in enumerate(whole.tolist()):
            yield [ids[stops[i] : stops[i + 1]].tobytes()] if good else self.runs(texts[i].as_py())

    def decode(self, runs: Iterable[bytes], block: int = 1 << 12) -> Iterator[str]:
        """The text of a stream of ids, completed characters at a time."""
        stream = Utf8Stream()
        for run in runs:
            ids = np.frombuffer(run, "<u4")
            for at in range(0, len(ids), block):
                some = ids[at : at + block]
                n = self.sizes[some]
                ends = np.cumsum(n)
                places = np.arange(int(ends[-1])) + np.repeat(self.starts[some] - (ends - n), n)
                yield stream.feed(self.bytes[places].tobytes())
        yield stream.feed(b"", last=True)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False, cached: int = 300_000) -> DataFrame:
    """doc_id with n_tokens, ids_sha256 and decoded_sha256 of each whole text; with_ids adds ids (binary) and decoded.

    The rank file is read on the driver and sent to the executors; its size is that of the vocabulary. `cached` matches, in
    two generations, and a third more transitions than that are kept in a worker: some 1 KB each, for speed.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))
    key = ("bpe", rank_file, pattern, cached)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(key, lambda: Codec(ranks.value, pattern, cached))
        for whole in batches:
            for batch in few_mb(whole, 4 << 20):
                out = [[] for _ in range(5)]
                for runs in codec.encode(batch.column("text")):
                    ids, decoded, n, kept = hashlib.sha256(), hashlib.sha256(), 0, ([], [])

                    def met(runs: Iterable[bytes]) -> Iterator[bytes]:
                        nonlocal n
                        for run in runs:
                            ids.update(run)
                            n += len(run) // 4
                            if with_ids:
                                kept[0].append(run)
                            yield run

                    for part in codec.decode(met(runs)):
                        decoded.update(part.encode("utf-8", "surrogatepass"))
                        if with_ids:
                            kept[1].append(part)
                    row = [n, ids.hexdigest(), decoded.hexdigest()]
                    for column, x in zip(out, row + [b"".join(kept[0]), "".join(kept[1])] * with_ids, strict=False):
                        column.append(x)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][: len(names)]
                made = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    made = f"n_tokens long, ids_sha256 string, decoded_sha256 string{', ids binary, decoded string' * with_ids}"
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(made).fields])
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
