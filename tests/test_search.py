"""Folded search by trigrams against reading every text."""

import os
import random
import unicodedata

from erario.operators.search import search_folded, write_trigram_index


def _fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower()


def test_search_equals_reading_every_text(spark, tmp_root):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("abcçéÉ 😀\n") for _ in range(rnd.randrange(40)))) for i in range(300)]
    rows += [(900, None), (None, "abc"), (901, ""), (902, "ab"), (903, "Saúde"), (903, "a saude b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS gram", "1 AS bucket")
    write_trigram_index(df, "doc_id", "text", tmp_root + "/index", buckets=4)
    keywords = ["abc", "ÇÉ", "É", "", "SAÚDE", "éa b", "zzz", "b😀", "abc", "a\nb", "aaaaaa"]
    got = search_folded(df, "doc_id", "text", tmp_root + "/index", keywords, buckets=4).collect()
    texts = [(i, _fold(t)) for i, t in rows if i is not None and t is not None]
    want = sorted((k, i) for k in set(keywords) for i, t in texts if _fold(k) in t)
    assert sorted((r.keyword, r.doc_id) for r in got) == want
    read = {r.keyword: r.n_read for r in got}
    assert read["SAÚDE"] == 2 and read["É"] == len(texts)
    folded = _fold("éa b")
    if "éa b" in read:
        assert read["éa b"] == min(sum(folded[i:i + 3] in t for _, t in texts) for i in range(2))


def test_search_reads_only_the_grams_of_its_keywords(spark, tmp_root):
    df = spark.createDataFrame([(i, f"common text {i}") for i in range(50)], "doc_id long, text string")
    write_trigram_index(df, "doc_id", "text", tmp_root + "/index")
    found = search_folded(df, "doc_id", "text", tmp_root + "/index", ["text 49"])
    assert [tuple(r) for r in found.collect()] == [("text 49", 49, 1)]


def test_search_without_texts_or_keywords(spark, tmp_root):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    write_trigram_index(df.limit(0), "doc_id", "text", tmp_root + "/none")
    assert search_folded(df.limit(0), "doc_id", "text", tmp_root + "/none", ["abc", "a"]).count() == 0
    write_trigram_index(df, "doc_id", "text", tmp_root + "/one")
    assert search_folded(df, "doc_id", "text", tmp_root + "/one", []).count() == 0
    assert search_folded(df, "doc_id", "text", tmp_root + "/one", ["zzz"]).count() == 0


def test_postings_are_written_where_they_are_made(spark, tmp_root):
    rows = [(i, f"text number {i} with a common part") for i in range(200)] + [(200, None), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    write_trigram_index(df, "doc_id", "text", tmp_root + "/index")
    files = [os.path.join(d, f) for d, _, found in os.walk(tmp_root + "/index") for f in found if f.endswith(".parquet")]
    assert {os.path.dirname(f) for f in files} == {tmp_root + "/index"}  # no postings dealt by gram
    held = [[r.gram for r in spark.read.parquet(f).collect()] for f in files]
    assert all(grams == sorted(grams) for grams in held)
    assert sum(map(len, held)) == sum(len({t[i:i + 3] for i in range(len(t) - 2)}) for _, t in rows[:200])
