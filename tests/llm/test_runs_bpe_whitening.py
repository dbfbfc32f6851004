"""Periodic runs, byte-level BPE and whitening: brute force, round trips and
edge cases (NULLs, empty and very long texts, ties, repeated rows, empty tables,
clashing columns)."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from erario.llm import bytebpe, queries, runs, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -------------------------------------------------------------- periodic runs

def _brute_runs(w, least=6, exponent=4):
    """Every stretch with words q apart identical, for every q; its smallest
    period by trying all smaller ones."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                s = w[i:i + size]
                if not any(s[:-p] == s[p:] for p in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _brute_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 6)), max_size=6))
def test_runs_against_brute_force(parts):
    words = [w for block, times in parts for w in block * times]
    found = runs.find_runs(words)
    assert found == _brute_runs(words)
    assert " ".join(runs.collapse(words, found)) == _brute_collapse(words, found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_automaton_without_candidate_blocks(words):
    ids = np.array([ord(w) for w in words], np.int64)
    assert sorted(runs.runs_of(ids), key=lambda r: (r[0], r[2])) == _brute_runs(words)


def test_candidate_blocks_keep_only_near_repeats():
    rnd = random.Random(5)
    text = [f"w{rnd.randrange(10**9)}" for _ in range(300)]
    h = lambda w: np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    assert runs.candidate_blocks(h(text)) == []
    # a passage that comes again far away is no candidate, one that follows itself is
    assert runs.candidate_blocks(h(text + text[:40])) == []
    assert runs.candidate_blocks(h(text[:50] + text[50:60] * 5 + text[60:])) == [(50, 100)]


def test_long_texts_take_time_in_proportion():
    rnd = random.Random(7)
    period = [f"w{rnd.randrange(5000)}" for _ in range(9000)]
    assert runs.find_runs(period * 5) == [(0, 45000, 9000)]
    assert runs.find_runs(["a"] * 100_000) == [(0, 100_000, 1)]


RUN_ROWS = [
    (1, "a b a b a b a b a c"), (2, None), (3, ""), (4, " \t\n "), (5, "x"), (6, "x " * 5), (7, "x " * 6), (7, "x " * 6),
    (None, "y y y y y y y z z z z z z"), (8, "a b c " * 4 + "d " * 7), (9, "é  é  " * 9),
]


def test_detect_edges(spark):
    df = spark.createDataFrame(RUN_ROWS, "doc_id long, text string")
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("runs", "collapsed", "row", "in0", "_row_", "n_words", "start")])
    got = runs.detect(clash)
    assert set(clash.columns) == set(got.columns)
    rows = got.collect()
    assert len(rows) == len(RUN_ROWS)
    for r in rows:
        words = WORD.findall(r.text or "")
        assert [tuple(x) for x in r.runs] == _brute_runs(words)
        assert (r.n_words, r.collapsed) == (len(words), _brute_collapse(words, _brute_runs(words)))
        assert r.row == r._row_ == r.start == "x"
    assert runs.detect(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.detect(df, exponent=2)


def test_op11_whole_table(spark):
    """Every document of the smallest table, by brute force."""
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows)
    for r in rows:
        w = WORD.findall(texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = _brute_runs(w)
        best = min(found, key=lambda t: (-t[1], t[0], t[2]), default=(None,) * 3)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(r) == (
            r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{size},{q}\n" for s, size, q in found)), digest(_brute_collapse(w, found)))


# -------------------------------------------------------------- byte-level BPE

def _known():
    import public_tokenizers as known

    return known.path("byte_bpe_multi_50k.tiktoken"), known.PATTERN


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = _known()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.ByteCoder(*_known())


def _ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.text("aeé \n'sx1", max_size=200)))
def test_encode_as_the_library(text, coder, reference):
    ids = coder.encode([text])
    assert _ids(ids[0]) == reference.encode_ordinary(text)
    assert coder.decode(ids) == [text.encode()]


def test_every_code_point(coder, reference):
    text = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(text), 100_000):
        some = " a".join(text[start:start + 100_000])
        assert coder.find.findall(some) == [m.group() for m in coder.find.finditer(some)]
        assert b"".join(coder.encode([some])) == np.array(reference.encode_ordinary(some), "<u4").tobytes()


def test_long_words(coder, reference):
    """Words over LONG bytes take another query: also with ties, marked and unmarked merges."""
    rnd = random.Random(11)
    words = ["a" * 20_001, "ab" * 3_000, "é" * 900, "".join(rnd.choice("etaoinshr") for _ in range(1_500)),
             "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(400)), "=" * 777, " " * 5_000, "\n" * 333]
    for word, ids in zip(words, coder.encode(words)):
        assert _ids(ids) == reference.encode_ordinary(word)
        assert coder.decode([ids]) == [word.encode()]


def test_texts_longer_than_a_chunk(coder, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "CHUNK", 200)
    monkeypatch.setattr(bytebpe, "DECODE", 70)
    monkeypatch.setattr(bytebpe, "CACHED", 50)
    monkeypatch.setattr(bytebpe, "QUERY_BYTES", 40)
    rnd = random.Random(2)
    text = " ".join(f"wörd{rnd.randrange(10**6)}" for _ in range(500))
    for some in ([text], [text[:90], text[90:150], ""]):
        ids = coder.encode(some)
        assert [_ids(i) for i in ids] == [reference.encode_ordinary(t) for t in some]
        assert coder.decode(ids) == [t.encode() for t in some]


def test_encode_edges(spark, reference):
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "nul \x00   x"), (4, "hello world " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("ids", "n_tokens", "decoded", "row", "in0", "part", "pos")])
    got = bytebpe.encode(clash, *_known(), decoded=True)
    assert set(got.columns) == set(clash.columns)
    out = got.collect()
    assert sorted((r.doc_id or 0, r.text) for r in out if r.text) == sorted((d or 0, t) for d, t in rows if t)
    for r in out:
        assert _ids(r.ids) == reference.encode_ordinary(r.text or "") and r.n_tokens == len(_ids(r.ids))
        assert r.decoded == (r.text or "").encode() and r.part == "x"
    again = bytebpe.decode(got.drop("decoded"), *_known()).collect()
    assert [bytes(r.decoded) for r in again] == [(r.text or "").encode() for r in again]
    assert bytebpe.encode(df.limit(0), *_known()).collect() == []
    with pytest.raises(ValueError):
        bytebpe.ByteCoder(*_known()).decode([np.array([50256], "<u4").tobytes()])


def test_op12_whole_table(spark, reference):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert tuple(r) == (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                            hashlib.sha256(text.encode()).hexdigest())


# ------------------------------------------------------------------- whitening

def _brute_whitening(vectors, most=32):
    """All rows in one matrix, the fit list not grouped."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    return ([sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x],
            c @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum())


def _check(rows, vectors):
    """Rows of ``whiten`` in the order of ``vectors``; whole columns may change sign."""
    deviation, white, explained = _brute_whitening(vectors)
    assert [r.deviation for r in rows] == deviation and {r.n for r in rows} == {len(vectors)}
    got = np.array([r.whitened for r in rows])
    assert got.shape == white.shape
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    assert np.allclose(rows[0].explained, explained, rtol=1e-9)
    assert max(r.identity_error for r in rows) < 1e-9
    cov = (got - got.mean(axis=0)).T @ (got - got.mean(axis=0)) / len(got)
    assert np.abs(cov - np.eye(cov.shape[0])).max() < 1e-9


@pytest.mark.parametrize("d, n, copies", [(3, 40, 0), (40, 300, 0), (6, 3000, 1500)])
def test_whitening_against_brute_force(spark, d, n, copies):
    rnd = np.random.default_rng(d)
    vectors = (rnd.normal(size=(n, d)) * np.geomspace(0.5, 30, d)).round(3)
    vectors[:copies] = vectors[0]  # one vector with half of the rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<double>").repartition(7)
    _check(whitening.whiten(df, "v").orderBy("vec_id").collect(), vectors.tolist())


def test_whitening_of_dependent_entries_and_far_means(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(200, 2)) + 900.0
    vectors = np.column_stack([a, np.full(200, 3.0), a[:, 0]])  # a constant entry and a repeated one
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<double>")
    rows = whitening.whiten(df, "v").orderBy("vec_id").collect()
    assert len(rows[0].whitened) == 2
    _check(rows, vectors.tolist())


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]),
            (8, [0.25, -1.0]), (8, [0.25, -1.0]), (None, [2.0, 0.0]), (9, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("x", "weight", "row", "n", "whitened", "d", "_row_", "explained")])
    out = whitening.whiten(clash, "v")
    assert set(clash.columns) <= set(out.columns)
    got = sorted(out.collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    assert [r.vec_id for r in got] == [1, 8, 8, None] and {(r.x, r.weight, r.n) for r in got} == {("x", "x", 4)}
    _check(got, [r.v for r in got])
    assert whitening.by_component(out, "vec_id").count() == 8
    one = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, v array<float>")
    assert [(r.n, r.deviation, r.whitened) for r in whitening.whiten(one, "v").collect()] == [(2, 0, [])] * 2
    assert whitening.by_component(whitening.whiten(one, "v"), "vec_id").collect() == []
    empty = whitening.by_component(whitening.whiten(df.where("vec_id in (2, 3, 6)"), "v"), "vec_id")
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    large = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, v array<double>")
    assert [r.deviation for r in whitening.whiten(large, "v").orderBy("vec_id").collect()] == [None, None, 0]


def test_op13_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    rows = queries.QUERIES["op13_embedding_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    deviation, white, explained = _brute_whitening([r.embedding for r in table])
    k = white.shape[1]
    assert [(r.vec_id, r.component) for r in rows] == [(t.vec_id, c) for t in table for c in range(1, k + 1)]
    assert [r.deviation for r in rows[::k]] == deviation
    got = np.array([r.whitened for r in rows]).reshape(white.shape)
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-8
    assert np.allclose([r.explained for r in rows[:k]], explained)
