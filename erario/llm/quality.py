"""Quality rules as a short-circuit cascade.

Base counts are taken of every document. The further rules run one after the
other, each only on the documents that no earlier rule has rejected. Their
order comes from a sample: every rule's seconds and rejections are measured on
it and the rule with the most rejections per second among the documents still
left comes first. A document is kept if no rule rejects it, so the order
changes the work and never the verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SAMPLE_ROWS = 2000


def repeated_words(words: list[str], n: int = WINDOW) -> int:
    """Words that lie in an ``n``-word window (a power of two) which the text
    holds at least twice. Windows are numbered exactly by doubling: a window of
    2k words is the pair of the numbers of its two halves."""
    if len(words) <= n:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    width, counts = 1, None
    while width < n:
        pairs = ids[:-width] * np.int64(ids.max() + 1) + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0  # all shorter windows differ already
        width *= 2
    covered = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(counts[ids] > 1)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + n, -1)
    return int((np.cumsum(covered) > 0).sum())


@dataclass
class Document:
    """A text with what the rules look at, each computed when first asked for."""

    text: str
    words: list[str] = field(default_factory=list)

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def capitals(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def most_common(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORDS.search(x)]


@dataclass(frozen=True)
class Rule:
    """``rejects(document, base)``: base holds the base counts by name."""

    name: str
    rejects: Callable[[Document, dict], bool]


# Thresholds are whole-number ratios, so a verdict never hangs on rounding.
RULES = (
    Rule("symbols", lambda d, b: 100 * b["n_symbols"] > 20 * b["n_words"]),
    Rule("word_length", lambda d, b: not 2 * b["n_words"] <= b["word_chars"] <= 15 * b["n_words"]),
    Rule("shouting", lambda d, b: 100 * d.text.count("!") > 20 * b["n_words"]),
    Rule("capitals", lambda d, b: 100 * d.capitals > 40 * d.letters),
    Rule("letters", lambda d, b: 100 * d.letters < 60 * b["word_chars"]),
    Rule("one_word", lambda d, b: 100 * d.most_common > 30 * b["n_words"]),
    Rule("stutter", lambda d, b: 100 * sum(x == y for x, y in zip(d.words, d.words[1:])) > 20 * b["n_words"]),
    Rule("repeated_lines", lambda d, b: 100 * b["n_dup_lines"] > 50 * len(d.lines)),
    Rule("bullets", lambda d, b: 100 * sum(x.lstrip()[:1] in "-*•" for x in d.lines) > 90 * len(d.lines)),
    Rule("ellipses", lambda d, b: 100 * sum(x.rstrip().endswith(("...", "…")) for x in d.lines) > 30 * len(d.lines)),
)


def base_counts(text: str) -> tuple[Document, dict]:
    words = _WORDS.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return Document(text, words), {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(_SYMBOLS.findall(text)),
        "n_dup_lines": dup, "n_repeat_words": repeated_words(words)}


def _base_failed(b: dict) -> bool:
    return b["n_words"] < MIN_WORDS or 100 * b["n_repeat_words"] > MAX_REPEATED_PERCENT * b["n_words"]


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of ``rules``, most rejections per second first, measured on about
    ``sample_rows`` documents drawn by a hash of doc_id. Greedy: after each
    choice the others count only the documents that it left."""
    n = docs.count()
    part = max(1, n // sample_rows)
    sample = docs.select("doc_id", "text").where(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(part)) == 0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seconds, hits = Counter(), Counter()
            for text in pdf["text"]:
                doc, base = base_counts(text or "")
                if _base_failed(base):
                    continue
                mask = 0
                for i, r in enumerate(rules):
                    t = time.perf_counter()
                    mask |= bool(r.rejects(doc, base)) << i
                    seconds[i] += time.perf_counter() - t
                hits[mask] += 1
            yield pd.DataFrame([(-1 - i, s) for i, s in seconds.items()] + [(m, c) for m, c in hits.items()],
                               columns=["what", "amount"])

    got = {r["what"]: r["amount"] for r in sample.mapInPandas(measure, "what long, amount double")
           .groupBy("what").agg(F.sum("amount").alias("amount")).collect()}  # at most 2^rules masks
    seconds = {i: got.get(-1 - i, 0.0) + 1e-9 for i in range(len(rules))}
    masks = {m: c for m, c in got.items() if m >= 0}
    order, left = [], list(range(len(rules)))
    while left:
        best = max(left, key=lambda i: (sum(c for m, c in masks.items() if m >> i & 1) / seconds[i], -seconds[i], -i))
        order.append(rules[best].name)
        left.remove(best)
        masks = {m: c for m, c in masks.items() if not m >> best & 1}
    return order


OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, rejected_by string")


def judge(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """Return per row ``doc_id`` and the base counts, ``base_failed``, ``kept``
    and ``rejected_by`` (``base``, else the rule that fired, else NULL; which of
    several fitting rules is named follows the order).

    NULL text counts as empty, and a text without 20 words fails the base
    rules. Texts are read whole; repeated rows are judged each; other columns
    of ``docs`` are ignored. An empty table gives no rows.
    """
    names = order if order is not None else rule_order(docs, rules)
    by_name = {r.name: r for r in rules}
    cascade = [by_name[n] for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                doc, base = base_counts(text or "")
                failed = _base_failed(base)
                by = "base" if failed else next((r.name for r in cascade if r.rejects(doc, base)), None)
                rows.append((*base.values(), failed, by is None, by))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text: pandas would turn a whole-number column with NULLs into floats
    return (docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, f"doc_id string, {OUT}")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))
