"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams (1 to 3 characters, words
padded by a blank on each side) by rank. A document's own most frequent n-grams
are ranked the same way; its distance to a profile sums how far each n-gram is
out of place, an n-gram that the profile lacks counts the profile's length.
The nearest profile names the language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, frugal, from_row

_LETTERS = re.compile(r"[^\W\d_]+")
PROFILE = 400
SAMPLE_DOCS = 3000
UNKNOWN = "und"
_CACHED_WORDS = 30_000
_CACHED_GRAMS = 100_000
_TOGETHER = 100


class _Grams:
    """N-grams of texts with counts, through a bounded cache of words.

    A code packs up to three characters into 63 bits, so it means the same in
    every task; within a task codes are numbered, and a text's n-grams counted
    by their numbers.
    """

    def __init__(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.number: dict[int, int] = {}

    def _learn(self, words: list[str]) -> None:
        """N-grams of many new words at once, as one text with blanks between."""
        for w in words:
            self.words[w] = np.empty(0, np.int64)
        words = [w for w in words if any(map(str.isalpha, w))]
        if not words:
            return
        c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        blank = c == 32
        word = np.cumsum(blank) - 1
        inner = ~blank[1:-1]
        codes = np.concatenate([c[~blank], c[:-1] << 21 | c[1:], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner]])
        word = np.concatenate([word[~blank], word[:-1], word[1:-1][inner]])
        order = np.argsort(word, kind="stable")
        different, at = np.unique(codes[order], return_inverse=True)
        numbers = np.array([self.number.setdefault(x, len(self.number)) for x in different.tolist()], np.int64)
        self.words.update(zip(words, np.split(numbers[at], np.cumsum(np.bincount(word))[:-1])))

    def counts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and counts of each text's n-grams."""
        for i in range(0, len(texts), _TOGETHER):
            if len(self.words) > _CACHED_WORDS or len(self.number) > _CACHED_GRAMS:
                self.words, self.number = {}, {}
            found = [Counter(_LETTERS.findall((t or "").lower())) for t in texts[i:i + _TOGETHER]]
            self._learn(list(set().union(*found).difference(self.words)))
            codes = np.fromiter(self.number, np.int64, len(self.number))
            for words in found:
                parts = list(map(self.words.__getitem__, words))
                grams = np.concatenate(parts) if parts else np.empty(0, np.int64)
                times = np.repeat(np.fromiter(words.values(), np.float64, len(words)),
                                  np.fromiter(map(len, parts), np.int64, len(parts)))
                n = np.bincount(grams, times, len(codes))
                held = np.flatnonzero(n)
                yield codes[held], n[held].astype(np.int64)


def _top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The codes by falling count, ties by code, at most ``k``."""
    if len(codes) > k:
        often = counts >= np.partition(counts, -k)[-k]
        codes, counts = codes[often], counts[often]
    return codes[np.lexsort((codes, -counts))[:k]]


def fit_profiles(labelled: DataFrame, size: int = PROFILE, sample_docs: int = SAMPLE_DOCS,
                 ) -> dict[str, list[int]]:
    """Profiles from ``text`` and non-null ``lang`` of ``labelled``: a list of
    n-gram codes by rank for each language.

    About ``sample_docs`` documents of a language are read whole, drawn by a
    hash of doc_id (all, if there are fewer). What reaches the driver is
    bounded: languages x ``size`` codes.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[x for k, n in counts.items()
                                        for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.where(draw < share)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, total = _Grams(), {}
        for pdf in batches:
            for lang, (codes, n) in zip(pdf["lang"], g.counts(pdf["text"].tolist())):
                total.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), n.tolist())))
        for lang, c in total.items():
            yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})

    counted = (sample.select("lang", "text").mapInPandas(frugal(grams), "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    first = Window.partitionBy("lang", F.pmod(F.col("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (counted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size)
           .withColumn("r", F.row_number().over(best)).where(F.col("r") <= size))
    profiles: dict[str, list[int]] = {k: [] for k in sorted(counts)}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):
        profiles[r["lang"]].append(r["gram"])
    return {k: v for k, v in profiles.items() if v}


class _Scorer:
    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.size, self.langs, self.grams = size, sorted(profiles), _Grams()
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.langs), len(self.codes)), -1, np.int64)  # -1: not in the profile
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, profiles[k])] = np.arange(len(profiles[k]))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        places = np.arange(self.size)
        for codes, counts in self.grams.counts(texts):
            if not len(codes) or not self.langs:
                yield UNKNOWN, 0.0
                continue
            own = _top(codes, counts, self.size)
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            known = np.flatnonzero(self.codes[at] == own)
            rank = self.rank[:, at[known]]
            gain = np.where(rank < 0, 0, self.size - np.abs(rank - places[known])).sum(axis=1)
            best = int(gain.argmax())  # ties: the first language by code point
            yield self.langs[best], float(gain[best] / (self.size * len(own)))


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """Return all columns of ``docs`` with ``lang_pred`` and ``score`` (columns
    of these names are replaced).

    ``score`` is 1 for a document whose n-grams all have the profile's rank and
    0 if the profile holds none of them. Text that is NULL or has no letter, or
    any text where no profile was learned, is ``und`` with score 0. Only the
    whole text is read; ties go to the first language by code point.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(profiles, size)
        yield from frugal(lambda some: (pd.DataFrame(list(scorer.predict(t.tolist())), columns=["lang_pred", "score"])
                                        for t in some))(batches)

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(as_row(rest), predict(F.col("text")).alias("found")).select(*from_row(rest), "found.*")


def predict_languages(docs: DataFrame, size: int = PROFILE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the documents of ``docs`` that are not held out, predict all:
    its columns with ``held_out, lang_pred, score``."""
    marked = docs.drop("held_out").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), size, sample_docs)
    return identify(marked, profiles, size)
