"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all ways
to cut it into pieces, which a forward pass over its letters takes in one go; the score of a text is the sum over its
words. Piece probabilities are fitted by expectation maximisation on the words of labelled documents, with the
forward-backward counts of all segmentations; the vocabulary itself is never trained. `fit` takes a bounded sample of them,
`fit_all` every one.

A word is a run of letters, lower-cased, with the vocabulary's word mark before it. Pieces of one letter that the
vocabulary lacks share one probability. No piece of lower-case letters and no word is left out, however long. `score` is
the posterior of the predicted language for `evidence` letters at the text's mean log-likelihood a letter, under equal
priors, so that it does not saturate with length.

Edge cases: a null text, or one without a letter, is `und` with score 0. Without any labelled row every text is `und`.
Of languages that tie the first by name is predicted. A text is scored whole; 8 MB of texts, or one longer text, at once.
Repeated rows are judged one by one. Languages are the non-null values of lang in the labelled rows used. lang, source and doc_id
are no inputs of a prediction. Extra columns pass through `identify`; one with the name of a result gives way to it.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .columns import coded_words, few_mb, worker_cache
from .common import BROADCAST_IDS, compact, drop_settled, settled

MARK = "▁"
RUN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Production parameters of the fit."""

    rows: int = 300  # labelled documents a language at most; `fit_all` has no such bound
    words: int = 200_000  # distinct words a language that `fit` takes from them at most, the most frequent ones
    rounds: int = 3  # of expectation maximisation
    prior: float = 0.01  # pseudo-count of each piece
    evidence: float = 30.0  # letters
    cached: int = 150_000  # tokens whose likelihoods a worker keeps, in two generations


def read_pieces(path: str) -> list[str]:
    """The pieces of lower-case letters, with or without the word mark, in the order of the vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in found if p == MARK or (x := p.removeprefix(MARK)).isalpha() and x == x.lower()]


def runs_of(token: str) -> list[str]:
    """The words in a token, marked. Signs that count as numbers are no letters, even where a letter stands by."""
    found = RUN.findall(token.lower())
    return [MARK + r for r in found if r.isalpha()] + [MARK + x for r in found if not r.isalpha() for x in re.split(r"\W|\d", "".join(c if c.isalpha() else " " for c in r)) if x]


class Lattice:
    """All segmentations of words, as arrays of edges: words of one length at a time.

    An edge is a piece at a place of a word. Between any two letters that follow each other there is one, for letters that
    the vocabulary lacks that of `unknown`; so each place of each word has an edge that ends there and one that starts.
    """

    SAFE = 24  # letters up to which no product of probabilities underflows

    def __init__(self, pieces: list[str]) -> None:
        self.unknown, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.ids: dict[str, int] = {p[:i]: -1 for p in pieces for i in range(1, len(p))}  # beginnings of pieces
        self.ids.update((p, i) for i, p in enumerate(pieces))

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, word, start, piece) of all edges, sorted by these. All words have one length."""
        n, w, get, unknown, longest, v = len(words[0]), len(words), self.ids.get, self.unknown, self.longest, self.unknown + 1
        found: list[int] = []
        add = found.append
        for k, word in enumerate(words):
            for i in range(n):
                x = get(word[i], -1)
                add((((i + 1) * w + k) * n + i) * v + (x if x >= 0 else unknown))
                for j in range(i + 2, min(n, i + longest) + 1):
                    x = get(word[i:j])
                    if x is None:
                        break
                    if x >= 0:
                        add(((j * w + k) * n + i) * v + x)
        code = np.sort(np.array(found, dtype=np.int64))
        code, piece = np.divmod(code, v)
        code, start = np.divmod(code, n)
        end, word = np.divmod(code, w)
        return end, word, start, piece

    @staticmethod
    def _runs(outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted pairs: bounds of the runs of equal `outer`, and in each the places where `inner` changes."""
        cuts = np.flatnonzero(np.diff(outer)) + 1
        bounds = np.concatenate([[0], cuts, [len(outer)]])
        return bounds, [np.flatnonzero(np.diff(inner[a:b], prepend=-1)) for a, b in zip(bounds, bounds[1:])]

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]: log-likelihoods."""
        end, word, start, piece = self.edges(words)
        n = len(words[0])
        if n > self.SAFE:
            return self._logs(end, word, start, p[piece], n, len(words))[:, n]
        alpha = np.zeros((n + 1, len(words), p.shape[1]))
        alpha[0] = 1
        bounds, firsts = self._runs(end, word)
        for e, (a, b, at) in enumerate(zip(bounds, bounds[1:], firsts), 1):
            alpha[e] = np.add.reduceat(alpha[start[a:b], word[a:b]] * p[piece[a:b]], at, axis=0)
        return np.log(alpha[n])

    def _logs(self, end: np.ndarray, word: np.ndarray, start: np.ndarray, weight: np.ndarray, n: int, words: int) -> np.ndarray:
        """[word, end, language]: logs of the sums over all ways up to each end, each scaled by the end before."""
        out = np.zeros((words, n + 1, weight.shape[1]))
        bounds, firsts = self._runs(end, word)
        for e, (a, b, at) in enumerate(zip(bounds, bounds[1:], firsts), 1):
            w = word[a:b]
            got = np.exp(out[w, start[a:b]] - out[w, e - 1]) * weight[a:b]
            out[:, e] = out[:, e - 1] + np.log(np.add.reduceat(got, at, axis=0))
        return out

    @staticmethod
    def _by_length(words: list[str], letters: int) -> Iterator[tuple[list[int], list[str]]]:
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            by_length[len(word)].append(i)
        for length, rows in by_length.items():
            each = max(1, letters // length)
            for at in range(0, len(rows), each):
                yield rows[at : at + each], [words[i] for i in rows[at : at + each]]

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]."""
        out = np.zeros((len(words), p.shape[1]))
        for rows, some in self._by_length(words, 1 << 15):
            out[rows] = self.forward(some, p)
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts [piece, language], over all segmentations; counts[word, language]."""
        out = np.zeros_like(p)
        for rows, some in self._by_length(words, 1 << 15):
            end, word, start, piece = self.edges(some)
            n, weight = len(some[0]), p[piece]
            alpha = self._logs(end, word, start, weight, n, len(some))
            back = np.lexsort((word, n - start))  # the same from the other end, where a start at i is an end at n - i
            beta = self._logs(n - start[back], word[back], n - end[back], weight[back], n, len(some))
            got = np.exp(alpha[word, start] + beta[word, n - end] - alpha[word, n]) * weight * counts[rows][word]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(piece, got[:, k], len(p))
        return out


def fit(labelled: DataFrame, vocabulary: str, m: LanguageModel = LanguageModel()) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities[piece, language]) from the rows (doc_id, text, lang) with a text and a lang.

    Of each language the `rows` documents whose hashes are smallest; their words are counted on the executors.
    """
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = labelled.select("doc_id", "lang").filter("lang is not null and text is not null")
    some = some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= m.rows).select("doc_id", "lang").distinct()
    some = compact(some, "language-sample")
    sample = labelled.select("doc_id", "lang", "text")
    sample = sample.join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, ["doc_id", "lang"], "left_semi")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = defaultdict(int)
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for word in runs_of(text or ""):
                    found[lang, word] += 1
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "n"])

    counted = sample.mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    frequent = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    rows = counted.withColumn("r", frequent).filter(F.col("r") <= m.words).drop("r").toPandas()  # bounded a language
    pieces = read_pieces(vocabulary)
    if rows.empty:
        return [], pieces, np.zeros((len(pieces) + 1, 0))
    languages = sorted(rows["lang"].unique())
    table = rows.pivot_table(index="word", columns="lang", values="n", fill_value=0, aggfunc="sum")[languages]
    lattice = Lattice(pieces)
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    names, counts = table.index.tolist(), table.to_numpy(dtype=np.float64)
    for _ in range(m.rounds):
        p = lattice.expected(names, counts, p) + m.prior
        p /= p.sum(0)
    return languages, pieces, p


#: Expected counts are added up as whole numbers of this part, so that their sums depend on no order.
UNIT = 2.0**-20


def counted_words(labelled: DataFrame) -> DataFrame:
    """(word, languages, counts): each distinct word of the texts whose lang is not null, with how often which language has it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in few_mb(whole, 4 << 20):
                seen, codes, bounds = coded_words(batch.column("text"))
                cut = [runs_of(t) for t in seen]
                sizes = np.array([len(c) for c in cut], np.int64)
                words = pa.array([w for c in cut for w in c], pa.string())
                lang = batch.column("lang").dictionary_encode()
                of_word = np.repeat(np.asarray(lang.indices, dtype=np.int64), np.diff(bounds))
                pair, n = np.unique(of_word * len(seen) + codes, return_counts=True)
                k, code = np.divmod(pair, max(1, len(seen)))
                r = sizes[code]  # words of each token
                at = np.arange(r.sum()) + np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(r) - r), r)
                made = [lang.dictionary.take(pa.array(np.repeat(k, r))), words.take(pa.array(at)), pa.array(np.repeat(n, r), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["lang", "word", "n"])

    found = labelled.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(rows, "lang string, word string, n long")
    found = found.groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("c"))
    return found.select("word", F.col("c.lang").alias("languages"), F.col("c.n").alias("counts"))


def fit_all(labelled: DataFrame, vocabulary: str, m: LanguageModel = LanguageModel()) -> tuple[list[str], list[str], np.ndarray]:
    """As fit, from every word of every row with a text and a lang, rows that repeat a doc_id too.

    Words are counted and their expectations taken on the executors; the driver gets pieces times languages a round.
    """
    counted = settled(counted_words(labelled), "language-words")
    languages = sorted(r["x"] for r in counted.select(F.explode("languages").alias("x")).distinct().collect())
    pieces = read_pieces(vocabulary)
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(m.rounds if languages else 0):
        p = _expected(counted, languages, pieces, p) + m.prior
        p /= p.sum(0)
    drop_settled(counted)
    return languages, pieces, p


def _expected(counted: DataFrame, languages: list[str], pieces: list[str], p: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] of all words of `counted`, summed over its tasks."""
    shared = counted.sparkSession.sparkContext.broadcast((pieces, p))
    place, width = {x: i for i, x in enumerate(languages)}, len(languages)
    most = max(1, (1 << 19) // width)  # words at once: batches have few of each length

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
        words, rows, columns, n = [], [], [], []
        for batch in batches:
            for word, names, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [len(words)] * len(names)
                columns += [place[x] for x in names]
                n += counts
                words.append(word)
                if len(words) == most:
                    yield words, _dense(rows, columns, n, len(words), width)
                    words, rows, columns, n = [], [], [], []
        if words:
            yield words, _dense(rows, columns, n, len(words), width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p = shared.value
        lattice, total = Lattice(pieces), np.zeros_like(p)
        for words, counts in blocks(batches):
            total += lattice.expected(words, counts, p)
        whole = np.rint(total / UNIT).astype(np.int64).ravel()
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(whole[at], pa.int64())], ["at", "x"])

    found = counted.select("word", "languages", "counts").mapInArrow(sums, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(p.size)
    out[found["at"].to_numpy(np.int64)] = found["x"].to_numpy(np.float64) * UNIT
    shared.destroy()
    return out.reshape(p.shape)


def _dense(rows: list[int], columns: list[int], n: list[int], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width))
    out[rows, columns] = n
    return out


class Scorer:
    """Log-likelihoods of tokens between white space, kept in two generations of bounded size."""

    def __init__(self, pieces: list[str], p: np.ndarray, most: int) -> None:
        self.lattice, self.p, self.most = Lattice(pieces), p, most
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, p.shape[1] + 1), np.float32)
        self.older: tuple[dict[str, int], np.ndarray] = {}, self.table

    def _add(self, tokens: list[str]) -> None:
        """Rows of the table for tokens: the log-likelihoods of their words, and their count of letters."""
        old_rows, old_table = self.older
        known = [t for t in tokens if t in old_rows]
        new = [t for t in tokens if t not in old_rows]
        cut = [runs_of(t) for t in new]
        owner = np.repeat(np.arange(len(new)), [len(c) for c in cut])
        words = [w for c in cut for w in c]
        got = np.zeros((len(new), self.table.shape[1]), np.float64)
        if words:
            distinct = list(dict.fromkeys(words))
            place = {w: i for i, w in enumerate(distinct)}
            which = np.array([place[w] for w in words])
            np.add.at(got[:, :-1], owner, self.lattice.log_likelihood(distinct, self.p)[which])
            np.add.at(got[:, -1], owner, [len(w) - 1 for w in words])
        again = old_table[[old_rows[t] for t in known]] if known else np.zeros((0, got.shape[1]), np.float32)
        self.rows.update(zip(known + new, range(len(self.table), len(self.table) + len(tokens)), strict=True))
        self.table = np.concatenate([self.table, again, got.astype(np.float32)])

    def score(self, texts: pa.Array) -> np.ndarray:
        """[text, languages + 1]: log-likelihoods, then letters."""
        seen, codes, bounds = coded_words(texts)
        missing = [t for t in seen if t not in self.rows]
        if len(self.rows) + len(missing) > self.most:
            self.older = self.rows, self.table
            self.rows, self.table, missing = {}, np.zeros((0, self.table.shape[1]), np.float32), seen
        if missing:
            self._add(missing)
        rows = np.fromiter(map(self.rows.__getitem__, seen), np.int64, len(seen))[codes]
        sums = np.zeros((len(bounds), self.table.shape[1]))
        for at in range(len(bounds) - 1):
            sums[at] = self.table[rows[bounds[at] : bounds[at + 1]]].sum(0, dtype=np.float64)
        return sums[:-1]


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], m: LanguageModel = LanguageModel(), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, under `names`."""
    docs = docs.select([c for c in docs.columns if c not in names])

    languages, pieces, p = model
    if not languages:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((pieces, p))  # vocabulary times languages
    key, evidence, cached = uuid.uuid4().hex, m.evidence, m.cached

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(key, lambda: Scorer(*shared.value, cached))
        for whole in batches:
            for batch in few_mb(whole, 4 << 20):
                sums = scorer.score(batch.column("text"))
                letters = sums[:, -1]
                mean = sums[:, :-1] / np.maximum(letters, 1)[:, None] * np.minimum(letters, evidence)[:, None]
                mean -= mean.max(1, keepdims=True)
                best = mean.argmax(1)
                score = 1 / np.exp(mean).sum(1)
                pred = [languages[b] if n else "und" for b, n in zip(best, letters, strict=True)]
                made = [pa.array(pred, pa.string()), pa.array(np.where(letters > 0, score, 0.0))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(rows, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2
