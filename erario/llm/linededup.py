"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that hold a word. A unit is the
shortest run of lines from a given line on that has ``unit_words`` words, a
window the shortest that has ``window_words``. Of every window the unit with
the least hash is its fingerprint, so places that share a window share a
fingerprint. Fingerprints found at several places bring their windows together;
each window is joined by position to its first occurrence, the match is
extended line by line both ways, and the later lines are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, saved, scratch, small_side

UNIT_WORDS = 25
WINDOW_WORDS = 50
_ENTRY = ("text_key long, finger long, first_raw int, last_raw int, before array<long>, before_raw array<int>, "
          "after array<long>, after_raw array<int>, windows array<struct<window:long,line:int>>")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def fingerprints(text: str, unit_words: int, window_words: int) -> list[tuple]:
    """Selected units of a text: hash, first and last line (counting all lines),
    the lines around it as hashes and numbers outwards from the unit until they
    hold ``window_words`` words, and the windows that selected it: hash and
    first line (counting lines with a word)."""
    import xxhash

    raw, hashes, sizes = [], [], []
    for i, line in enumerate(text.split("\n")):
        words = line.split()
        if words:
            raw.append(i)
            hashes.append(_signed(xxhash.xxh3_64_intdigest(" ".join(words))))
            sizes.append(len(words))
    n = len(raw)
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)

    def ends(least: int) -> list[int]:
        """For each line the line after the shortest run with ``least`` words; n + 1 if there is none."""
        out, e = [], 0
        for i in range(n):
            while e <= n and total[e] - total[i] < least:
                e += 1
            out.append(e)
        return out

    unit_end, window_end = ends(unit_words), ends(window_words)
    unit_hash = [_signed(xxhash.xxh3_64_intdigest(repr(hashes[i:e]))) if e <= n else None
                 for i, e in enumerate(unit_end)]
    chosen: dict[int, list[tuple[int, int]]] = {}
    queue: list[int] = []  # starts of units by rising hash, the later of equals first
    nxt = head = 0
    for i in range(n):
        if window_end[i] > n:
            break
        while nxt < n and unit_end[nxt] <= window_end[i]:
            while len(queue) > head and unit_hash[queue[-1]] >= unit_hash[nxt]:
                queue.pop()
            queue.append(nxt)
            nxt += 1
        while queue[head] < i:
            head += 1
        window = _signed(xxhash.xxh3_64_intdigest(repr(hashes[i:window_end[i]]), 1))
        chosen.setdefault(queue[head], []).append((window, i))
    out = []
    for i, windows in chosen.items():
        e = unit_end[i]
        b, a = i, e
        while b > 0 and total[i] - total[b] < window_words:
            b -= 1
        while a < n and total[a] - total[e] < window_words:
            a += 1
        out.append((unit_hash[i], raw[i], raw[e - 1], hashes[b:i][::-1], raw[b:i][::-1], hashes[e:a], raw[e:a], windows))
    return out


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def repeated_runs(docs: DataFrame, unit_words: int = UNIT_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, text_key, runs``: for each document with later repeats the
    line ranges ``(first, last)`` to delete, counted in its own lines from 0.

    Places are ordered by doc_id (NULL last), hash of the text and line. A
    window is compared with its first occurrence alone, found by a
    pre-aggregated minimum, so a passage in N documents makes N rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", *(c.split()[0] for c in _ENTRY.split(", "))]
        for pdf in batches:
            yield pd.DataFrame([(d, k, *f) for d, k, t in zip(pdf["doc_id"], pdf["text_key"], pdf["text"])
                                for f in fingerprints(t, unit_words, window_words)], columns=names)

    texts = (docs.where("text is not null")
             .select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_key"), "text"))
    entries = saved(texts.mapInPandas(frugal(select), f"doc_id string, {_ENTRY}")
                    .withColumn("doc_id", F.col("doc_id").cast(kind)), "line-fingerprints")
    def place(line: str) -> Column:
        return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"),
                        F.col("text_key").alias("text_key"), F.col(line).alias("line"))

    # only fingerprints and windows of several places go on; a repeated row is the same place
    def several(rows: DataFrame, key: str, line: str, name: str) -> DataFrame:
        first = F.min(F.struct(place(line).alias("place"), "before", "after"))
        return saved(rows.groupBy(key).agg(first.alias("o"), F.max(place(line)).alias("last")).where("o.place != last")
                     .select(key, F.col("o.place").alias("place"), F.col("o.before").alias("o_before"),
                             F.col("o.after").alias("o_after")), name)

    shared = several(entries, "finger", "first_raw", "line-shared").select("finger")
    windows = saved(entries.join(shared, "finger").withColumn("w", F.explode("windows"))
                    .select("*", "w.window", "w.line").drop("w", "windows", "finger"), "line-windows")
    met = windows.join(several(windows, "window", "line", "line-first"), "window").where(F.col("place") < place("line"))
    nb, na = _agree(F.col("before"), F.col("o_before")), _agree(F.col("after"), F.col("o_after"))
    run = F.struct(F.when(nb > 0, F.get("before_raw", nb - 1)).otherwise(F.col("first_raw")).alias("first"),
                   F.when(na > 0, F.get("after_raw", na - 1)).otherwise(F.col("last_raw")).alias("last"))
    return met.groupBy("doc_id", "text_key").agg(F.collect_set(run).alias("runs"))


def dedup_lines(docs: DataFrame, unit_words: int = UNIT_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Return ``docs`` with later repeated runs deleted from ``text`` and the
    columns ``n_lines`` (of the old text) and ``n_removed`` (columns of these
    names are replaced).

    A window (the shortest run of lines from a line on with ``window_words``
    words) that an earlier place holds too is deleted, with the lines next to it
    that agree with those around its first occurrence; shorter repeats stay.
    Earlier means a smaller doc_id (then the text's hash, then the line), the
    same document included. Lines are equal if their words are; lines without
    words inside a deleted run go with it. Repeated rows of one
    document lose the same lines. NULL text stays NULL with no lines.
    """
    with scratch(docs.sparkSession) as keep:
        runs = keep(saved(repeated_runs(docs, unit_words, window_words), "line-runs"))
    # the document travels as one value, so its columns cannot clash with the runs
    row = docs.drop("n_lines", "n_removed").select(F.struct("*").alias("row"))
    same = (F.xxhash64("row.text") == F.col("text_key")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    joined = row.join(small_side(runs, "runs"), same, "left").select("row", "runs")
    lines = F.split("row.text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
    out = joined.withColumns({"kept": F.when(F.col("runs").isNotNull(), kept),
                              "all": F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long")})
    text = F.coalesce(F.array_join("kept", "\n"), F.col("row.text")).alias("text")
    gone = F.when(F.col("runs").isNull(), 0).otherwise(F.col("all") - F.size("kept")).cast("long")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in columns],
                      F.col("all").alias("n_lines"), gone.alias("n_removed"))
