"""Bounded-space online packing of tokenised documents into fixed sequences.

Each partition reads its documents once and keeps a fixed number of open
sequences. A piece goes into the open sequence that it fills best; if none has
room, the fullest one is filled up with the front of the piece and emitted. The
sequences still open at the end of the partitions are merged by groups of
partitions, and what is left of a group is cut at the sequence length and, for
the last tokens, at powers of two, which need no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, release_memory, saved

LENGTH = 2048
OPEN = 32
#: A gap below this is padded rather than filled by cutting a document.
MIN_CUT = 8
END_ID = 1
MERGE = 8
#: Words and pieces whose ids a task keeps: more memory, fewer repeats of work.
CACHED = 300_000
_PIECES = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Texts with these go to the tokenizer whole: special tokens, signs that lower
#: case turns into others, and what is white space to ``str.split`` alone.
_WHOLE = ("<|", "\u0130", "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f")
_ID = attrgetter("id")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Words(dict):
    """Ids of words and of their pieces, all in lower case; a bounded cache that
    starts afresh when it is full."""

    def __init__(self, tokenizer, most: int) -> None:
        super().__init__()
        self.tokenizer, self.tokenize, self.most = tokenizer, tokenizer.model.tokenize, most
        # the byte-level alphabet: printable bytes as they are, the others from U+0100 on (fixed values)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", map(_ID, self.tokenize(shown))).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        plain = word.isascii()
        if not plain and not unicodedata.is_normalized("NFC", word) or "'" in word:
            ids = self.whole(word)
        elif word.isalpha():
            ids = self.piece(word)
        else:
            pieces = _PIECES.findall(word)
            if pieces == [word]:
                ids = self.piece(word) if plain or word.isdecimal() or not word[0].isalnum() else self.whole(word)
            else:
                ids = b"".join([self[p] for p in pieces])
        self[word] = ids
        return ids


class WordTokenizer:
    """Token ids as little-endian uint32 bytes.

    The vocabulary's tokenizer drops white space, lower-cases, and splits a word
    into runs of letters, single numerals and runs of other signs; no token
    crosses these borders. So words, and their pieces, are encoded once and kept
    in a bounded cache. Where a border could move (words not in composed form,
    apostrophes, numerals other than digits; texts with a special token or with
    signs that change their kind in lower case) the tokenizer gets the whole.
    """

    def __init__(self, path: str, cached: int = CACHED) -> None:
        from tokenizers import Tokenizer

        self.words = _Words(Tokenizer.from_file(path), cached)
        release_memory()  # reading the file takes twice what the vocabulary keeps

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _WHOLE):
            return self.words.whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


class Packer:
    """Open sequences of pieces ``(doc, start, ids, doc_tokens)``; ids are bytes."""

    def __init__(self, length: int, most: int, min_cut: int, first_id: int) -> None:
        self.length, self.most, self.min_cut, self.next = length, most, min_cut, first_id
        self.open: list[list] = []  # [free, pieces]
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = self.length
        while len(ids) // 4 >= size:
            self.emit([(doc, start, ids[: 4 * size], total)])
            start, ids = start + size, ids[4 * size:]
        n = len(ids) // 4
        if not n:
            return
        fit = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
        if fit is None and len(self.open) >= self.most:
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if full[0] >= self.min_cut:
                cut = full[0]
                full[1].append((doc, start, ids[: 4 * cut], total))
                start, ids, n = start + cut, ids[4 * cut:], n - cut
            self.emit(full[1])
        if fit is None:
            fit = [size, []]
            self.open.append(fit)
        fit[0] -= n
        fit[1].append((doc, start, ids, total))
        if not fit[0]:
            self.open.remove(fit)
            self.emit(fit[1])

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def close(self) -> None:
        """Cut what is still open into whole sequences and powers of two."""
        row, have = [], 0
        rest = sum(self.length - w[0] for w in self.open)
        want = min(self.length, 1 << max(rest, 1).bit_length() - 1)
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            for doc, start, ids, total in pieces:
                while ids:
                    cut = min(want - have, len(ids) // 4)
                    row.append((doc, start, ids[: 4 * cut], total))
                    start, ids, have, rest = start + cut, ids[4 * cut:], have + cut, rest - cut
                    if have == want:
                        self.emit(row)
                        row, have = [], 0
                        want = min(self.length, 1 << max(rest, 1).bit_length() - 1)
        self.open = []


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, open_windows: int = OPEN,
         min_cut: int = MIN_CUT, end_id: int = END_ID, merge: int = MERGE,
         cached: int = CACHED) -> DataFrame:
    """Pack the documents (``doc_id, text``) and return one row per piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of its whole text (NULL: none) and ``end_id``.
    ``vocabulary`` is the path of a tokenizer file on every executor. A table's
    partitions are read in place; repeated rows are packed each; other columns
    are ignored and an empty table gives no rows. A retried task packs its
    partition the same way. The pieces are written to the shared folder before
    the open sequences are merged, so texts are encoded once. ``cached`` bounds
    the ids a task keeps and changes no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in PIECE.split(", "))]
    # ids travel as text: pandas would turn a whole-number column with NULLs into floats
    piece, both = f"doc_id string, {PIECE}", f"doc_id string, {PIECE}, part long, ids binary"
    texts = docs.select(F.col("doc_id").cast("string"), "text")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode = WordTokenizer(vocabulary, cached).encode  # its caches go with the task
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(length, open_windows, min_cut, part << 32)
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                ids = encode(text or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
            yield pd.DataFrame(packer.take(), columns=names).assign(part=None, ids=None)
        left = [(d, s, len(i) // 4, 0, t, n, 0, part, i)
                for n, (_, pieces) in enumerate(packer.open) for d, s, i, t in pieces]
        if left:
            yield pd.DataFrame(left, columns=[*names, "part", "ids"])

    def second(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(length, open_windows, min_cut, 1 << 62 | int(key[0]) << 32)
        pdf = pdf.sort_values(["length", "part", "sequence_id", "doc_id", "start"], ascending=[False, *[True] * 4],
                              kind="stable")
        for doc, start, ids, total in zip(pdf["doc_id"].tolist(), pdf["start"].tolist(), pdf["ids"], pdf["doc_tokens"].tolist()):
            packer.add(doc, start, ids, total)
        packer.close()
        return pd.DataFrame(packer.take(), columns=names)

    all_pieces = saved(texts.mapInPandas(frugal(first), both), "packing")
    group = F.floor(F.col("part") / merge).alias("group")
    merged = all_pieces.where("part is not null").groupBy(group).applyInPandas(second, piece)
    return (all_pieces.where("part is null").select(*names).unionByName(merged)
            .withColumn("doc_id", F.col("doc_id").cast(kind)))
