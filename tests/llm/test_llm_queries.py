"""The registered queries over the small test tables: SQL where there is some,
else a brute-force version, a round trip or held-out accuracy."""

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL
from oracle import compare, duck

import corpus_pipeline
from erario.llm import queries as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _table(name):
    return pq.read_table(f"{SF_SMALL}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(Q.QUERIES[name](spark, SF_SMALL), con, Q.ORACLES[name])
    assert ok, msg


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES} == set(range(1, 14))


def test_page_text_is_the_article(spark):
    got = {r.page_id: r for r in Q.QUERIES["op2_page_text"](spark, SF_SMALL).collect()}
    pages = _table("pages")
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        want = " ".join(html.unescape(plain).split())
        assert got[p["page_id"]].text == want and got[p["page_id"]].n_chars == len(want)


def test_quality_base_counts(spark):
    got = {r.doc_id: r for r in Q.QUERIES["op8_quality_rules"](spark, SF_SMALL).collect()}
    docs = _table("documents")
    assert len(got) == len(docs)
    for d in docs:
        w = WORDS.findall(d["text"])
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        lines = [x for x in d["text"].split("\n") if WORDS.search(x)]
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in d["text"]))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    labels = {x["doc_id"]: x["quality"] for x in _table("labels")}
    clean = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    junk = [i for i, q in labels.items() if q == 0]
    assert all(got[i].kept for i in clean)
    assert sum(not got[i].kept for i in junk) >= 0.95 * len(junk)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary())
    rows = Q.QUERIES["op9_packing"](spark, SF_SMALL).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    docs = _table("documents")
    assert set(by_doc) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = [*tok.encode(d["text"], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r.start):
            piece = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(ids))
            at += r.length
        assert at == len(ids)
    used = padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        used += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * used


def test_language_held_out_accuracy(spark):
    rows = Q.QUERIES["op10_language_id"](spark, SF_SMALL).collect()
    truth = {d["doc_id"]: d["lang"] for d in _table("documents")}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_mix_follows_the_targets(spark):
    rows = Q.QUERIES["op6_source_mix"](spark, SF_SMALL).collect()
    source = {d["doc_id"]: d["source"] for d in _table("documents")}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and len(r.slots.split(",")) <= 3
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= max(2, 0.01 * t) for s, t in target.items())
    assert math.isclose(sum(target.values()), sum(r.size for r in rows), rel_tol=1e-9)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = docs.collect()
    n = len(_table("documents"))
    assert len(seen["language"]) == n  # every document is in some language
    assert 0 < len(seen["near_duplicates"]) < len(seen["lines"]) <= n
    ids = [r.doc_id for r in seen["near_duplicates"]]
    assert len(ids) == len(set(ids))
    assert set(r.doc_id for r in seen["mix"]) <= set(ids)
    assert max(Counter(r.doc_id for r in seen["mix"]).values()) <= 3
    assert Q.QUERIES and corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= len(seen["mix"])
