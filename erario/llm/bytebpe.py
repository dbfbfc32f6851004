"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each task.

A text is split by the vocabulary's pattern; each match is encoded on its own.
The bytes of the matches that a worker has not met yet are rows (word, position,
token). One recursive query joins neighbouring tokens with the merge table,
contracts each word's leftmost pair of least rank and goes on with the words
that still had a pair. Ids are decoded by a join with the vocabulary and an
aggregation ordered by position. No row leaves its partition, so no key can be
hot and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Characters of texts that a task works on at a time, and tokens of one decoding query.
CHUNK = 2_000_000
DECODE = 500_000
#: Words whose ids a Python worker keeps from task to task, and bytes of new words
#: in one encoding query.
CACHED = 500_000
QUERY_BYTES = 1_000_000
#: Words of more bytes go through the query that contracts many pairs a step.
LONG = 64
#: Steps of one query for long words: bounds the rows that the recursion keeps.
LONG_STEPS = 8

_MERGES = """
CREATE TABLE merges AS
SELECT (l.id::BIGINT << 32) | r.id AS pair, w.id, false AS every
FROM (SELECT id, s, unnest(range(1, length(s))) AS k FROM vocab) w
JOIN vocab l ON l.s = left(w.s, w.k) JOIN vocab r ON r.s = substr(w.s, w.k + 1)"""

# A merge is marked if its result is in no pair of a lower rank: then contracting
# one of its places cannot bring up a pair that would have to go first.
_MARK = """
UPDATE merges SET every = true WHERE id NOT IN (
  SELECT pair >> 32 FROM merges WHERE id <= pair >> 32
  UNION ALL SELECT pair & 4294967295 FROM merges WHERE id <= pair & 4294967295)"""

# A row's key is word << 32 | position, so one sort by a number orders all words.
_ENCODE = """
WITH RECURSIVE t(step, key, id) AS (
  SELECT 0, key, id FROM bytes
  UNION ALL (
  WITH n AS MATERIALIZED (
    SELECT step, key, id, lead(id) OVER w AS next, lead(key) OVER w AS after, lag(key) OVER w AS before
    FROM t WINDOW w AS (ORDER BY key)),
  b AS (SELECT key >> 32 AS word, min((merges.id::BIGINT << 32) | (key & 4294967295)) AS best
        FROM n JOIN merges ON merges.pair = (n.id::BIGINT << 32) | next WHERE after >> 32 = key >> 32 GROUP BY key >> 32)
  SELECT step + 1, key, CASE WHEN key & 4294967295 = best & 4294967295 THEN (best >> 32)::INTEGER ELSE id END
  FROM n JOIN b ON key >> 32 = word WHERE before IS DISTINCT FROM (word << 32) | (best & 4294967295)))
SELECT (t.key >> 32)::INTEGER AS word, t.id FROM t
JOIN (SELECT key >> 32 AS word, max(step) AS step FROM t GROUP BY 1) l ON t.key >> 32 = l.word AND t.step = l.step
ORDER BY t.key"""

# The same for long words: a marked merge is contracted at all its places that do
# not overlap, counted from the left of each run of them; others at the leftmost.
_ENCODE_LONG = f"""
WITH RECURSIVE t(step, word, pos, id) AS (
  SELECT 0, key >> 32, key & 4294967295, id FROM bytes
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN taken THEN merged ELSE id END
  FROM (SELECT *, coalesce(lag(taken) OVER w, false) AS gone FROM (
    SELECT *, merged IS NOT NULL AND (pos = first OR every
              AND (nth - min(nth) OVER (PARTITION BY word, merged, run)) % 2 = 0) AS taken
    FROM (SELECT *, nth - row_number() OVER (PARTITION BY word, merged ORDER BY pos) AS run FROM (
      SELECT *, CASE WHEN rank = least THEN rank END AS merged,
             min(CASE WHEN rank = least THEN pos END) OVER (PARTITION BY word) AS first
      FROM (SELECT step, word, pos, p.id, nth, merges.id AS rank, every,
                   min(merges.id) OVER (PARTITION BY word) AS least
            FROM (SELECT step, word, pos, id, lead(id) OVER w AS next, row_number() OVER w AS nth FROM t
                  WHERE step < {LONG_STEPS} WINDOW w AS (PARTITION BY word ORDER BY pos)) p
            LEFT JOIN merges ON merges.pair = (p.id::BIGINT << 32) | next)
      WHERE least IS NOT NULL)))
    WINDOW w AS (PARTITION BY word ORDER BY pos))
  WHERE NOT gone)
SELECT (t.word << 32) | t.pos AS key, t.id, l.step FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) l
ON t.word = l.word AND t.step = l.step ORDER BY t.word, t.pos"""

_DECODE = """
SELECT part, string_agg(s, '' ORDER BY pos) AS s FROM ids JOIN vocab USING (id) GROUP BY part ORDER BY part"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file (a line: base64 of the token, its rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteCoder:
    """The merge table and the vocabulary in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True
        # no folder for temporary files: nothing may go to a machine's own disk
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        # a byte is the character of its number, so a token is a string of such characters
        self._register("words", id=np.fromiter(self.ranks.values(), np.int32, len(self.ranks)),
                       s=[t.decode("latin-1") for t in self.ranks])
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM words")
        self.db.execute(_MERGES)
        self.db.execute(_MARK)
        self.cache: dict[str, bytes] = {}

    def _register(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    # ------------------------------------------------------------- encoding

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as little-endian uint32 bytes. A word that is a token is
        that token, whatever its merges would give."""
        out, some, size = {}, [], 0
        long = []
        for word in words:
            data = word.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[word] = whole.to_bytes(4, "little")
            elif len(data) > LONG:
                long.append((word, data))
            else:
                some.append((word, data))
                size += len(data)
                if size >= QUERY_BYTES:
                    self._short(some, out)
                    some, size = [], 0
        self._short(some, out)
        for item in long:
            self._long(item, out)
        return out

    def _rows(self, words: list[tuple[str, bytes]]) -> None:
        sizes = np.fromiter((len(d) for _, d in words), np.int32, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(d for _, d in words), np.uint8)]
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        self._register("bytes", key=(word << 32) | (np.arange(len(ids)) - starts), id=ids)

    def _short(self, words: list[tuple[str, bytes]], out: dict[str, bytes]) -> None:
        if not words:
            return
        self._rows(words)
        found = self.db.sql(_ENCODE).to_arrow_table()
        ends = np.cumsum(np.bincount(found["word"].to_numpy(), minlength=len(words))).tolist()
        ids = found["id"].to_numpy().astype("<u4").tobytes()
        start = 0
        for (word, _), end in zip(words, ends):
            out[word] = ids[4 * start:4 * end]
            start = end

    def _long(self, word: tuple[str, bytes], out: dict[str, bytes]) -> None:
        self._rows([word])
        while True:
            found = self.db.sql(_ENCODE_LONG).to_arrow_table()
            if found["step"][0].as_py() < LONG_STEPS:  # the last step found no pair
                out[word[0]] = found["id"].to_numpy().astype("<u4").tobytes()
                return
            self._register("bytes", key=found["key"], id=found["id"])

    def slices(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern; those of a long text in several lists."""
        if len(text) <= CHUNK:
            yield self.find.findall(text)
            return
        matches = self.find.finditer(text)
        while some := [m.group() for m in islice(matches, CHUNK // 8)]:
            yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of about ``CHUNK`` characters together, or of one longer text."""
        cache = self.cache
        out: list[list[bytes]] = [[] for _ in texts]
        pending: list[tuple[int, list[str]]] = []

        def flush() -> None:
            words = {w for _, some in pending for w in some}
            new = [w for w in words if w not in cache]
            if len(cache) + len(new) > CACHED:  # the words of this chunk stay
                held = {w: cache[w] for w in words if w in cache}
                cache.clear()
                cache.update(held)
            cache.update(self.encode_words(new))
            for k, some in pending:
                out[k].append(b"".join(map(cache.__getitem__, some)))
            pending.clear()
            for w in new:
                if len(w) > LONG:
                    del cache[w]

        for k, text in enumerate(texts):
            for some in self.slices(text):
                pending.append((k, some))
                if len(text) > CHUNK:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]

    # ------------------------------------------------------------- decoding

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that lists of ids (little-endian uint32) stand for."""
        out: list[list[bytes]] = [[] for _ in ids]
        some, owner, size = [], [], 0

        def flush() -> None:
            if not some:
                return
            sizes = np.array([len(a) for a in some])
            flat = np.concatenate(some)
            if flat.max(initial=0) >= len(self.known) or not self.known[flat].all():
                raise ValueError("an id that the vocabulary does not hold")
            self._register("ids", part=np.repeat(np.arange(len(some), dtype=np.int32), sizes),
                           pos=np.arange(len(flat), dtype=np.int32), id=flat.astype(np.int32))
            found = self.db.sql(_DECODE).to_arrow_table()
            for part, text in zip(found["part"].to_pylist(), found["s"].to_pylist()):
                out[owner[part]].append(text.encode("latin-1"))
            some.clear()
            owner.clear()

        for k, data in enumerate(ids):
            row = np.frombuffer(data, "<u4")
            for start in range(0, len(row), DECODE):
                piece = row[start:start + DECODE]
                some.append(piece)
                owner.append(k)
                size += len(piece)
                if size >= DECODE:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=1)
def _coder(path: str, pattern: str) -> ByteCoder:
    return ByteCoder(path, pattern)


def _chunks(values: list, size: Callable[[object], int], most: int) -> Iterator[list]:
    some, total = [], 0
    for v in values:
        if some and total + size(v) > most:
            yield some
            some, total = [], 0
        some.append(v)
        total += size(v)
    if some:
        yield some


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` long and ``ids`` binary (little-endian uint32):
    the ids of every whole text; with ``decoded`` also ``decoded`` binary, the
    bytes that these ids stand for.

    ``vocabulary`` is the path of a rank file on every executor. NULL and empty
    texts have no ids. Equal texts, repeated rows and rows without an id are
    encoded each; all other columns stay, those named like the results are
    replaced; an empty table gives an empty one. Every word is bounded by its
    text alone; a task holds about ``CHUNK`` characters or one text at a time.
    """
    def run() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        coder = _coder(vocabulary, pattern)

        def add(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            ids, back = [], []
            for some in _chunks(texts, len, CHUNK):
                found = coder.encode(some)
                ids += found
                if decoded:
                    back += coder.decode(found)
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            return [counts, pa.array(ids, pa.binary())] + ([pa.array(back, pa.binary())] if decoded else [])

        return add

    return add_columns(docs, [F.col(text)], "n_tokens long, ids binary" + (", decoded binary" if decoded else ""), run)


def decode(rows: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` binary: the bytes of each row's ``ids`` (binary,
    little-endian uint32; NULL: empty). An id outside the vocabulary is an error."""
    def run() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        coder = _coder(vocabulary, pattern)
        return lambda batch: [pa.array(coder.decode([i or b"" for i in batch.column(0).to_pylist()]), pa.binary())]

    return add_columns(rows, [F.col(ids)], "decoded binary", run)
