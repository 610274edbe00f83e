"""Phrases, byte-level BPE and whitening against brute force, libraries and their edge cases."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marketframe.llm import bpe, phrases, queries, whitening
from test_llm import LOWER, corpus, sentence

TEXTS = "doc_id long, text string, lang string, phrase string, f long, part int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- phrases


def mined(rows, max_words=3, least=10, percent=50, top=2000):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, max_words + 1) for i in range(len(ws) - k + 1))
    frequent = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    subsumed = set()
    for p, a in frequent.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                part = (p[0], *p[i : i + k])
                if 100 * a >= percent * f[part]:
                    subsumed.add(part)
    for p, a in frequent.items():
        if p not in subsumed:
            cuts = [(int(Fraction(1_000_000 * a * a, f[p[: k + 1]] * f[(p[0], *p[k + 1 :])])), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    ranked, seen = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(out):  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.add((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def spoken(seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        ws = [f"w{min(int(r.zipf(1.6)), 40)}" for _ in range(int(r.integers(0, 60)))]
        for at in range(0, len(ws), 7):
            ws[at : at + 1] = r.choice(["New York City", "a. b c", "x x x x", "Ünder É\x0bzz", "to\tbe,or", "q"]).split(" ")
        rows.append((" ".join(ws), [None, "und", "en", "de"][i % 4]))
    rows += [("", "en"), (None, "en"), (None, None), (" .,;\n", "xx"), ("hot word " * 3000, "en"), (rows[5]), (rows[5])]
    return rows


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (3, 10, 5), (2, 4, 2000), (4, 6, 2000)])
def test_phrases(spark, max_words, least, top):
    rows = spoken(max_words + least)
    docs = spark.createDataFrame([(i, *x, "p", 1, 1) for i, x in enumerate(rows)], TEXTS).repartition(5)
    got = phrases.phrases(docs, max_words, least, 50, top).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == mined(rows, max_words, least, 50, top)


def test_phrases_in_small_chunks_and_full_bitmaps(spark, monkeypatch):
    """Texts cut in memory, stripes in parts and a bitmap that is full change no result."""
    rows = [(", ".join(["one two three"] * 40 + ["x" * 300]) + " tail of words without an end " * 30, "en"), *spoken(9)]
    docs = spark.createDataFrame([(i, *x, "p", 1, 1) for i, x in enumerate(rows)], TEXTS).repartition(2)
    want = mined(rows)
    # workers import the modules anew: small values go by their bodies here
    data = np.frombuffer(rows[0][0].encode(), np.uint8)
    monkeypatch.setattr(phrases, "PIECE", 64)
    cut = list(phrases._cut(data))
    assert len(cut) > 5 and b"".join(c.tobytes() for c in cut) == data.tobytes() and all(phrases.ENDS[c[-1]] for c in cut[:-1])
    monkeypatch.setattr(phrases, "BITS", 8)
    monkeypatch.setattr(phrases, "PARTS", 64)
    got = phrases.phrases(docs).collect()
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == want


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], TEXTS)
    assert phrases.phrases(docs).count() == 0
    assert phrases.phrases(spark.createDataFrame([(1, None, None, None, None, None)], TEXTS)).count() == 0


def test_large_counts_are_exact(spark):
    big = 999_999_999_999_989
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 1_000_000 * big * big // ((big + 1) * (big + 7))


# --- byte-level BPE


@pytest.fixture(scope="module")
def known():
    return bpe.vocabulary(RANKS)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


PARTS = ["'s", "'ll", "'l", "'re", "'v", "''s", " 's", "'S", "don't", " ", "  ", "\n", "\t", " \n ", " ", " ", "\x85", "​", "\x1c", "abc", "É", "é", "中文", "字", "١٢", "½", "123", "_", "!?", "…", "🎉", "\U0001f469‍\U0001f4bb", "\x00", "\x7f", "\U000105c0", "<|endoftext|>", "'", "'d'm't"]


def odd_texts():
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(PARTS, int(r.integers(0, 40)))) for _ in range(600)]
    return [*texts, "", None, " ", "\n\n", "a" * 5000, "ab" * 3000 + " " * 3000 + "x", "é" * 4000, "'" * 999, " word" * 40_000, "9" * 4000, texts[3], texts[3]]


def test_classes_are_those_of_the_library(known):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    table = bpe.classes()
    for pattern, kind in ((r"\p{L}", bpe.LETTER), (r"\p{N}", bpe.NUMBER), (r"\s", bpe.SPACE)):
        found = bytes(tiktoken.Encoding("c", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        assert sorted(map(ord, found)) == [c for c in np.flatnonzero(table == kind) if not 0xD800 <= c < 0xE000]


def test_encoding(spark, known, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, starts string, ids array<int>").repartition(3)
    made = docs.select("doc_id", "starts", bpe.encode(known, F.col("text")).alias("e"))
    got = made.select("doc_id", "e.ids", "e.starts", bpe.decode(known, F.col("e.ids"), F.col("e.starts")).alias("back")).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text), text[:80]
        assert bytes(r.back) == text.encode()
        sizes = [len(known.tokens[i]) for i in r.ids]
        assert r.starts == list(np.cumsum([0, *sizes])[: len(sizes)])
    assert docs.limit(0).select(bpe.encode(known, F.col("text"))).count() == 0


@pytest.mark.parametrize("size", [16, 33, 200])
def test_windows_hand_the_state_on(known, library, size):
    for text in odd_texts()[:150]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        if len(data):
            found = [int(b) for at in bpe.slices(data, np.array([0, len(data)]), size) for b in at[:-1]]
            cut = [data[a:b].tobytes() for a, b in zip(found, [*found[1:], len(data)], strict=True)]
            assert [i for p in cut for i in known.merged(p)] == library.encode_ordinary(text)


def test_scan_in_blocks_is_the_automaton():
    r = np.random.default_rng(0)
    found = r.integers(0, 16, 5000).astype(np.uint8)
    state, want = bpe.IN_O, []
    for s in found:
        want.append(bpe.BEGINS[s * 8 + state])
        state = bpe.STEP[s * 8 + state]
    begins, last = bpe.scan(found, bpe.IN_O)
    assert begins.tolist() == want and last == state


def test_decoding_of_lists(spark, known):
    rows = spark.createDataFrame([(1, [0, 1], [0, 1]), (2, None, None), (3, [], [])], "i int, ids array<int>, starts array<int>")
    got = {r.i: r.b for r in rows.select("i", bpe.decode(known, F.col("ids"), F.col("starts")).alias("b")).collect()}
    assert bytes(got[1]) == known.tokens[0] + known.tokens[1] and got[2] is None and bytes(got[3]) == b""
    with pytest.raises(Exception, match="vocabulary lacks"):
        rows.select(bpe.decode(known, F.array(F.lit(60_000)), F.array(F.lit(0)))).collect()


def test_bpe_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


# --- whitening


def check_whitened(got, rows, components=4, counted=False, tolerance=1e-7):
    """Against exact sums and a direct eigendecomposition."""
    keep = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    sizes = Counter(len(x) for _, x in keep)
    size = max(sizes, key=lambda s: (sizes[s], s))
    keep = [(i, x) for i, x in keep if len(x) == size]
    weights = Counter(tuple(x) for _, x in keep)
    weights = weights if counted else dict.fromkeys(weights, 1)
    n, sums = sum(weights.values()), [sum(x[d] * w for x, w in weights.items()) for d in range(size)]
    x, w = np.array(list(weights), float), np.array(list(weights.values()), float)
    c = x - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh((c * w[:, None]).T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    top = min(components, size)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k + 1) for i, _ in keep for k in range(top))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-7
    exact = {i: (sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x) for i, x in keep}
    for k, rs in by.items():
        z = {i: (np.array(x, float) - np.array([s / n for s in sums])) @ axes[:, k - 1] / np.sqrt(values[k - 1]) for i, (_, x) in exact.items()}
        sign = np.sign(sum(r.whitened * z[r.vec_id] for r in rs))
        for r in rs:
            assert r.deviation == exact[r.vec_id][0] and r.whitened == pytest.approx(sign * z[r.vec_id], abs=tolerance)


def embedded():
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.normal(0, [3, 2, 1.5, 1, 0.5, 0.2])]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a hot vector
    return rows


ODD = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0, 2.0]), (2005, []), (None, [-0.0, 0.0, 0.0, 0.0, 0.0, 1e-9])]
EMBEDDED = "vec_id long, embedding array<double>, x string, w int, z int"


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows = embedded() + ODD
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], EMBEDDED).repartition(5)
    check_whitened(whitening.whiten(table, weights=weights).collect(), rows, counted=weights == "count")


def test_whitening_defined_cases(spark):
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in ODD[:4]], EMBEDDED)
    assert whitening.whiten(table).count() == 0
    assert whitening.whiten(table.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 0.0, 5.0, 2.0, 2.0], "x", 1, 1), (2, [2.0, 0.0, 5.0, 2.0, 2.0], "x", 1, 1), (2, [2.0, 0.0, 5.0, 2.0, 2.0], "x", 1, 1)], EMBEDDED)
    got = whitening.whiten(flat).collect()
    assert len(got) == 12 and all((r.whitened is None) == (r.component > 1) and r.n == 2 and r.deviation == 2**16 and r.identity_error < 1e-9 for r in got)
    assert {r.vec_id: abs(r.whitened) for r in got if r.component == 1} == {1: pytest.approx(1), 2: pytest.approx(1)}
    one = whitening.whiten(flat.limit(1)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in one)
    far = spark.createDataFrame([(1, [1e200], "x", 1, 1), (2, [-1e200], "x", 1, 1)], EMBEDDED)  # beyond 64 bits
    assert [r.deviation for r in whitening.whiten(far).collect()] == [None, None]


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitened(queries.op13_embedding_whitening(spark, sf_dir).collect(), rows)


def test_corpus_goes_through(spark, known, library):
    rows = corpus(seed=8)
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [(7, sentence(np.random.default_rng(0), 150_000, 90), "en")], "doc_id long, text string, lang string")
    want = mined([(r.text, r.lang) for r in docs.collect()])
    got = phrases.phrases(docs).collect()
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == want
    for r in docs.select("text", bpe.encode(known, F.col("text")).alias("e")).collect():
        assert r.e.ids == library.encode_ordinary(r.text or "")
