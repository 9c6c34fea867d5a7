"""Quality rules, BPE, language ID, token files and the Jaccard join against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mailprism.llm import bpe, jaccard, language, quality, tokenfile
from mailprism.llm.queries import QUERIES

SEP = re.compile("[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, score double, n_words string"
LONG = "word " * 30_000 + "end " * 5


def words(text):
    return [w for w in SEP.split(text or "") if w]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated and tied rows, and columns whose names clash with results."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, "en", "a", 1.0, "x"), (2, "", None, None, None, None), (3, " \t\n ", "en", "a", 2.0, "x"), (4, LONG, "en", "b", 0.0, "y"),
        (5, base, "de", "b", 0.0, "y"), (5, base, "de", "b", 0.0, "y"), (6, base, None, None, 0.0, "y"), (None, base, "en", "c", 0.0, "z"),
        (7, base + " extra", "de", "c", 0.0, "z"), (8, "a b", "en", "c", 0.0, "z"), (9, "a b", "en", "c", 0.0, "z"), (10, "漢字 \x00 ½ 🙂", "en", "c", 0.0, "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- quality rules


def base_measures(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, twice = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            twice += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), twice, len(covered), failed


def test_quality_measures(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_quality_rules"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(docs[r.doc_id])
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    least = min(-1e-3, 2 * np.quantile([r.score for r in got if r.doc_id in good and r.n_words >= 50], 0.001))
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in got if abs(r.score - least) > 1e-8)


def test_quality_separates(spark):
    """Documents that labels call bad are mostly rejected, good ones kept; the score is the mean log ratio."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    rates = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert rates[1] == 1.0 and rates[0] < 0.2


def test_quality_score_brute(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    rules = quality.QualityRules(buckets=64)
    judged = quality.judge(odd, labels, rules)
    assert judged.columns.count("score") == judged.columns.count("n_words") == 1
    got = judged.select("doc_id", "text", "score").collect()
    from pyspark.sql import Row

    hashes = {}
    for r in quality.with_hashes(odd).select("text", F.concat("_mp_w1", "_mp_w2").alias("h")).collect():
        hashes[r.text] = [h % 64 for h in r.h]
    raw, target = Counter(), Counter()
    for r in odd.collect():
        raw.update(hashes[r.text])
        if r.doc_id == 5:
            target.update(hashes[r.text])
    n, m = sum(raw.values()) + 64, sum(target.values())
    ratio = {}
    for b in range(64):
        p = (raw[b] + 1) / n
        ratio[b] = np.log((target[b] + 256 * p) / (m + 256) / p)
    for r in got:
        h = hashes[r.text]
        want = sum(ratio[b] for b in h) / len(h) if h else 0.0
        assert r.score == pytest.approx(want, abs=1e-9), Row(r)


def test_quality_counts_every_trusted_document(spark, monkeypatch):
    """More trusted rows than the 20,000 of an earlier bound, and more than one set of ids."""
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rules = quality.QualityRules(buckets=64)
    hashes = quality.with_hashes(docs).select(F.explode(F.concat("_mp_w1", "_mp_w2")).alias("h")).selectExpr("pmod(h, 64) as b")
    n = np.array([r["count"] for r in hashes.groupBy("b").count().orderBy("b").collect()])
    raw = (n + 1) / (n.sum() + 64)
    want = np.log((n + 256 * raw) / (n.sum() + 256) / raw)  # all are trusted
    for most in (1_000_000, 7_000):
        monkeypatch.setattr(quality, "BROADCAST_IDS", most)
        assert quality.fit(docs, labels, rules).first()["ratio"] == pytest.approx(want.tolist(), abs=1e-12)
    assert quality.trusted_ids(labels).count() == 20_500


def test_pipeline_stage_keeps_by_every_trusted_document(spark, sf, monkeypatch):
    """The first stage judges alike however many sets the trusted ids are sent in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    whole = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    monkeypatch.setattr(quality, "BROADCAST_IDS", 15)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == whole and len(whole) > 0


def test_quality_cuts_only_trusted_texts_for_the_threshold(spark, sf):
    """Otherwise each set of ids costs the words of all documents."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.select("doc_id", "text").join(F.broadcast(quality.trusted_ids(labels)), "doc_id", "left_semi")
    ratio = spark.createDataFrame([([0.0] * (1 << 14),)], "ratio array<double>")
    found = quality.trusted_scores(some, ratio, quality.QualityRules())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan.split("Join LeftSemi")[0] and "split(" not in plan.split("Join LeftSemi")[1]
    assert sum(r.x is None for r in found.collect()) == sum(len(words(r.text)) < 50 for r in some.collect())


def test_exact_quantile(spark):
    values = np.random.default_rng(5).normal(0, 1e-3, 3_000).tolist() + [0.25] * 400 + [-0.5] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for p in (0.0, 0.001, 0.3, 0.9, 1.0):
        assert quality.exact_quantile(df, p) == pytest.approx(np.quantile(values, p), abs=1e-15)
    assert quality.exact_quantile(df.limit(0), 0.5) is None and quality.exact_quantile(df.limit(1), 0.5) == values[0]


def test_quality_empty(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, labels).count() == 0
    assert quality.keep_good(none, labels).columns == none.columns


def test_quality_filter_is_not_pushed_down(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {5, 6, 7, None}


# ---- BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_matches_merges(ranks, reference):
    codec, rnd = bpe.Codec(ranks, P.PATTERN, max_cached=50), random.Random(1)
    codec.transducer.max_transitions = 500
    tokens, letters = list(ranks), "aabcdeéñ漢字 ́\n\t ..,,'s##ththe  ing🙂\x00"
    texts = ["", " ", "a" * 3000, "ab" * 2000, "漢" * 700, LONG[:2000]]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 8))).decode("utf-8", "replace") for _ in range(2000)]
    for text in texts:
        runs = list(codec.runs(text))
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == reference.encode_ordinary(text)
        assert "".join(codec.decode(runs)) == text


def test_tokens_are_settled_early(ranks, reference):
    """What is held back of a long match stays bounded for these runs; every token comes once, in order."""
    transducer = bpe.Transducer(ranks)
    rnd = random.Random(4)
    for piece in ("a" * 20_000, "ab" * 10_000, "漢" * 7_000, "".join(rnd.choice("etaoinshrdlu") for _ in range(20_000))):
        got, most = [], 0
        for tokens, held in transducer.stream(piece.encode()):
            got += tokens
            most = max(most, held)
        assert [ranks[t] for t in got] == reference.encode_ordinary(piece)
        assert most < 1024


def test_texts_in_columns(ranks, reference):
    """Texts cut at spaces have the ids of whole texts, whatever stands beside the spaces."""
    codec, rnd = bpe.Codec(ranks, P.PATTERN, max_cached=60), random.Random(5)
    assert codec.spaced and not bpe.Codec(ranks, r"(?s).+").spaced
    letters = ["a", "b", "the", "'s", "'", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2028", "1", "é", "漢", ".", "🙂", "\x00"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(6000)] + [None, "", " ", " a", "a "]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, runs in zip(some, codec.encode(pa.array(some, pa.string())), strict=True):
            runs = list(runs)
            assert np.frombuffer(b"".join(runs), "<u4").tolist() == reference.encode_ordinary(text or "")
            assert "".join(codec.decode(runs, block=3)) == (text or "")


def test_byte_bpe_query(spark, sf, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(reference.encode_ordinary(docs[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_long_text_in_runs(ranks, reference):
    codec = bpe.Codec(ranks, P.PATTERN, run=7)
    text = "The quick brown fox, ünïcode 漢字 jumps. " * 20
    runs = list(codec.runs(text))
    assert len(runs) > 1 and np.frombuffer(b"".join(runs), "<u4").tolist() == reference.encode_ordinary(text)
    assert "".join(codec.decode(runs)) == text


def test_small_vocabulary_with_unreachable_token():
    ranks = {bytes((i,)): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    codec = bpe.Codec(ranks, r"(?s).+")
    for text in ("abc", "abcbc", "bcab", "xyz", "xyzx", "aabbcc", "abcabcab"):
        whole = [text.encode()] if text.encode() in ranks else bpe.merge(text.encode(), ranks)
        assert b"".join(codec.runs(text)) == b"".join(codec.of[t] for t in whole)


def test_utf8_stream_at_every_cut():
    data = "aé漢🙂z".encode()
    for cut in range(len(data) + 1):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.feed(b"", last=True) == "aé漢🙂z"
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe6\xbc") + s.feed(b"", last=True) == "a�"


def test_bpe_query(spark, odd, none, reference):
    rows = bpe.encode_decode(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((r.doc_id or 0) for r in odd.collect())
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == texts
    for r in rows:
        ids = np.array(reference.encode_ordinary(r.decoded), dtype="<u4").tobytes()
        assert (r.ids_sha256, r.n_tokens) == (hashlib.sha256(ids).hexdigest(), len(ids) // 4)
    assert bpe.encode_decode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


# ---- language ID


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    lattice = language.Lattice(pieces)
    p = np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2]])

    def brute(word):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, min(3, len(word)) + 1):
            piece = word[:n]
            if piece in pieces or n == 1:
                total += p[pieces.index(piece) if piece in pieces else len(pieces), 0] * brute(word[n:])
        return total

    for word in ("a", "ab", "aba", "abab", "xaby", "bababa", "abxab" * 6):
        assert lattice.log_likelihood([word], p)[0, 0] == pytest.approx(np.log(brute(word)))
    long = "ab" * 4000
    assert np.isfinite(lattice.log_likelihood([long], p)).all()


def test_expected_counts_are_those_of_all_segmentations():
    pieces = ["a", "aa", "b"]
    lattice = language.Lattice(pieces)
    p = np.array([[0.5, 0.2], [0.3, 0.1], [0.1, 0.6], [0.1, 0.1]])
    words, counts = ["aa", "aab", "baa", "x"], np.array([[1.0, 2.0], [3.0, 0.0], [0.5, 1.0], [1.0, 0.0]])

    def ways(word):
        if not word:
            yield []
        for n in range(1, min(2, len(word)) + 1):
            if word[:n] in pieces or n == 1:
                yield from ([pieces.index(word[:n]) if word[:n] in pieces else 3, *rest] for rest in ways(word[n:]))

    want = np.zeros_like(p)
    for word, c in zip(words, counts):
        for k in range(2):
            found = [(np.prod(p[w, k]), w) for w in ways(word)]
            for share, way in found:
                for piece in way:
                    want[piece, k] += c[k] * share / sum(x for x, _ in found)
    assert lattice.expected(words, counts, p) == pytest.approx(want)
    long = lattice.expected(["a" * 2000], np.array([[1.0, 1.0]]), p)
    assert np.isfinite(long).all() and (long[0] + 2 * long[1]) == pytest.approx([2000, 2000])


def test_language_brute_force(spark, sf):
    """lang_pred and score of every document, by a plain forward pass over each word."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.filter(~language.held_out(F.col("doc_id")))
    languages, pieces, p = language.fit(train, P.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) == 16
    place = {x: i for i, x in enumerate(pieces)}
    seen = {}

    def word(w):
        if w not in seen:
            a = np.zeros((len(w) + 1, len(languages)))
            a[0] = 1
            for end in range(1, len(w) + 1):
                for start in range(max(0, end - 16), end):
                    i = place.get(w[start:end], len(pieces) if end - start == 1 else None)
                    if i is not None:
                        a[end] += a[start] * p[i]
            seen[w] = np.log(a[-1])
        return seen[w]

    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, sf).collect()}
    for r in docs.collect():
        found = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        letters = sum(map(len, found))
        if not letters:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        mean = sum(word("▁" + w) for w in found) / letters * min(letters, 30)
        e = np.exp(mean - mean.max())
        assert got[r.doc_id].lang_pred == languages[int(mean.argmax())]
        assert got[r.doc_id].score == pytest.approx(1 / e.sum(), abs=1e-5)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    met = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert met.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
    accuracy = met.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert accuracy >= 0.98
    assert met.filter("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark, odd, none):
    model = language.fit(odd, P.path("piece_bpe_32k.model"))
    assert model[0] == ["de", "en"]
    got = language.identify(odd, model)
    assert got.count() == odd.count() and got.columns.count("score") == 1
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert language.fit(none, P.path("piece_bpe_32k.model"))[0] == []
    assert {r.lang_pred for r in language.identify(odd, ([], [], np.zeros((0, 0)))).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
    assert language.runs_of("1½²") == [] and language.runs_of("Ab1cd") == ["▁ab", "▁cd"]


def test_language_fit_all_counts_every_word(spark, odd):
    """Probabilities from all words of all labelled rows, also beyond the bounds of fit."""
    rows = [(i, f"wort{'abc'[i % 3]} Ä{'x' * (i % 40)}Σ a1b's {i}", ["de", "en", None][i % 3]) for i in range(1000)] + [(None, "null id", "en"), (1, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for some in (docs, odd):
        counts, lattice = defaultdict(Counter), language.Lattice(language.read_pieces(P.path("piece_bpe_32k.model")))
        for r in some.filter("lang is not null").collect():
            counts[r.lang].update(language.runs_of(r.text or ""))
        names = sorted({w for c in counts.values() for w in c})
        n, p = np.array([[counts[x][w] for x in ("de", "en")] for w in names], float), np.full((lattice.unknown + 1, 2), 1 / (lattice.unknown + 1))
        for _ in range(3):
            p = lattice.expected(names, n, p) + 0.01
            p /= p.sum(0)
        languages, _, got = language.fit_all(some, P.path("piece_bpe_32k.model"))
        assert languages == ["de", "en"] and np.abs(got / p - 1).max() < 1e-3


def test_pipeline_language_learns_from_every_document(spark, sf):
    """Beyond the 300 documents a language that a sample takes, words that no document of the sample has."""
    ids = spark.range(3_000).filter(~language.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(1_050)
    rows = []
    for i, r in enumerate(ids.collect()):
        lang, late = ["de", "en", "fr"][i % 3], i >= 990
        rows.append((r.id, "z z z z z z" if late else {"de": "b b b", "en": "c c c", "fr": "d d d"}[lang], "en" if late else lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, docs, sf).count() == 1_050
    assert corpus_pipeline.language_id(spark, docs.limit(0), sf).count() == 0


# ---- token files


def test_elias_fano():
    rnd = random.Random(1)
    for _ in range(60):
        v = np.sort(np.array([rnd.randint(0, 10 ** rnd.randint(0, 15)) for _ in range(rnd.randint(0, 1500))], dtype=np.uint64))
        e = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(v).to_bytes())
        assert (e.values(0, len(v)) == v).all()
        for first in rnd.sample(range(len(v) + 1), min(5, len(v) + 1)):
            last = rnd.randint(first, len(v))
            assert (e.values(first, last) == v[first:last]).all()
        assert all(e[i] == int(v[i]) for i in rnd.sample(range(len(v)), min(20, len(v))))
    v = np.arange(0, 10**6, 97)
    assert len(tokenfile.EliasFano.encode(v).to_bytes()) < len(v) * 10 / 8 + 100


def token_brute(rows):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 100).alias("doc_id"), "text"))
    manifest = tokenfile.write(docs, P.path("word_bpe_49k.json"), 2, shards=5)
    got = sorted(map(tuple, tokenfile.read(manifest).collect()), key=lambda r: r[1])
    assert got == token_brute([tuple(r) for r in docs.collect()])
    assert tokenfile.read(tokenfile.write(none, P.path("word_bpe_49k.json"), 2)).count() == 0
    first = min(manifest.collect(), key=lambda r: r.start)
    shard = tokenfile.TokenFile(first.path)
    assert zlib.crc32(shard.document(1).tobytes()) == got[1][3] and shard.doc_id(0) == got[0][0]


def test_token_file_query(spark, sf):
    got = sorted(map(tuple, QUERIES["op7_token_file"](spark, sf).collect()), key=lambda r: r[1])
    assert got == token_brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_special_tokens_and_a_repeated_id(spark):
    rows = [(i % 3 or None, f"a <|endoftext|> b{i} <|startoftext|>X") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokenfile.write(docs, P.path("word_bpe_49k.json"), 2, shards=5)
    assert manifest.count() > 3
    assert sorted(map(tuple, tokenfile.read(manifest).collect()), key=lambda r: r[1]) == token_brute(rows)


def test_word_cache_is_the_tokenizer():
    cache = tokenfile.WordCache(open(P.path("word_bpe_49k.json")).read(), 2, max_cached=40)
    assert cache.splits
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd, letters = random.Random(2), "aab éñ漢字́ ͅ\n\t ..,,'s##the  ing🙂\x00\x1c\x1d\x85  <|endoftext|>İΣςJ̌"
    texts = ["one <|endoftext|> two", "one<|endoftext|>Two.", "A<|ENDOFTEXT|>b", "<|startoftext|>, hi!", "x<|endoftext|>.", "É<|endoftext|>É <|endoftext|"] * 50
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        flat, bounds = cache.encode(pa.array(some, pa.string()))
        for text, a, b in zip(some, bounds, bounds[1:]):
            assert flat[a:b].tolist() == tk.encode(text, add_special_tokens=False).ids + [2]


# ---- Jaccard join


def jaccard_brute(rows, percent=75):
    texts = {}
    for doc_id, text in rows:
        if doc_id is not None:
            texts[doc_id] = min(texts.get(doc_id, text), text, key=lambda t: (t is None, t or "")) if doc_id in texts else text
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists, common = defaultdict(list), Counter()
    for i in sorted(sets):
        for g in sets[i]:
            for j in lists[g]:
                common[j, i] += 1
            lists[g].append(i)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_ngram_jaccard_join"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute(docs) and len(got) == len(docs)


def test_jaccard_group_of_near_copies(spark):
    """Copies with edits of their own, chains of links, and a passage that unrelated documents share."""
    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rnd.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    passage = " ".join(rnd.choice(vocabulary) for _ in range(40))
    rows += [(1000 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((5, 9, 12, 60)))) + " " + passage) for i in range(150)]
    rows += [(2000 + i, rows[0][1].upper()) for i in range(30)]
    chain = [rnd.choice(vocabulary) for _ in range(60)]
    rows += [(3000 + i, " ".join(chain[i * 3 : i * 3 + 40])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (jaccard.JaccardJoin(), jaccard.JaccardJoin(most_bits=8, most_matches=3, hot=5), jaccard.JaccardJoin(percent=60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, p).collect()}
        assert got == jaccard_brute(rows, p.percent)


def test_jaccard_edges(spark, odd, none):
    got = jaccard.join(odd).collect()
    want = jaccard_brute([(r.doc_id, r.text) for r in odd.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    nameless = [r for r in got if r.doc_id is None]
    assert len(nameless) == 1 and nameless[0].component_id is None and nameless[0].n_shingles == 56
    assert jaccard.join(none).count() == 0
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (7, 4)], "a long, b long")
    assert {r.id: r.root for r in jaccard.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 7: 4, 8: 4, 9: 4}
