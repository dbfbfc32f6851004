"""Periodic runs of words by a suffix automaton and link-cut access.

A run is a longest stretch of words with a smallest period q that it repeats at
least ``exponent`` times. Every n-gram of ``GRAM`` words inside such a run occurs
again in the text, at most a quarter of the run away; stretches of such n-grams
are found first (``candidate_blocks``), and no run crosses their borders.

In a block, the automaton of all its words is built; its suffix links are a tree.
Words are then appended one by one: the path from the prefix's state to the root
gets the prefix's end as last occurrence. As in a link-cut tree, paths with one
last occurrence are splay trees, so an access passes few of them. A passed path
whose longest string has length l and ended last d words before gives a stretch
of l + d words with period d (a square, if l >= d), which is extended both ways.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, add_columns

LENGTH = 6
EXPONENT = 4
#: Words of the n-grams that mark candidate blocks: a run of at least ``LENGTH``
#: words and ``EXPONENT`` periods repeats each of its n-grams of this size.
GRAM = 5
_WORDS = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def candidate_blocks(hashes: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Stretches (start, end) of words in which all runs lie whole. ``hashes``
    holds one number a word; equal numbers of unequal words only make more
    blocks. In a stretch of m words an n-gram counts only if it occurs again
    within m / exponent words."""
    n = len(hashes) - GRAM + 1
    if len(hashes) < length:
        return []
    mixed = np.full(n, GRAM, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ hashes[k:k + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if not len(same):
        return []
    far = np.iinfo(np.int64).max // exponent
    near = np.full(n, far)
    left, right = order[same], order[same + 1]
    np.minimum.at(near, left, right - left)
    np.minimum.at(near, right, right - left)
    live = near < far
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return []
        sizes = ends - starts + GRAM - 1
        room = np.zeros(n, np.int64)
        room[live] = np.repeat(sizes, ends - starts)
        still = live & (near * exponent <= room) & (room >= length)
        if still.sum() == live.sum():
            return list(zip(starts.tolist(), (starts + sizes).tolist()))
        live = still


def _automaton(word_ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, greatest lengths and the state of each prefix."""
    moves: list[dict[int, int]] = [{}]
    link, longest, states = [-1], [0], []
    last = 0
    for w in word_ids:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = state
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if longest[p] + 1 == longest[q]:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(moves[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
        states.append(state)
    return link, longest, states


class _Paths:
    """Paths of one last occurrence as splay trees over the suffix-link tree.
    The root of a splay tree holds its path's last occurrence and, as parent,
    the state above the path."""

    def __init__(self, link: list[int]) -> None:
        self.parent = [p + 1 for p in link]  # states from 1 on; 0 is none
        self.parent.insert(0, 0)
        n = len(self.parent)
        self.left, self.right, self.last = [0] * n, [0] * n, [-1] * n

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree (left: nearer to the root)."""
        parent, left, right = self.parent, self.left, self.right
        p = parent[x]
        if left[p] != x and right[p] != x or not p:
            return
        while p and (left[p] == x or right[p] == x):
            g = parent[p]
            inner = g and (left[g] == p or right[g] == p)
            if not inner:
                self.last[x] = self.last[p]
            elif (left[g] == p) == (left[p] == x):
                self._rotate(p)
            else:
                self._rotate(x)
                p = parent[x]
                g = parent[p]
                if not (g and (left[g] == p or right[g] == p)):
                    self.last[x] = self.last[p]
            self._rotate(x)
            p = parent[x]

    def _rotate(self, x: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            parent[c] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        self.last[x] = self.last[p]
        parent[p] = x
        parent[x] = g

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Give the path from ``state`` to the root the last occurrence ``end``;
        return (deepest state, last occurrence before) of the paths passed."""
        passed = []
        below, x = 0, state + 1
        while x:
            self.splay(x)
            passed.append((x - 1, self.last[x]))
            cut = self.right[x]
            if cut:
                self.last[cut] = self.last[x]
            self.right[x] = below
            below, x = x, self.parent[x]
        self.last[below] = end
        return passed


def _equal_ahead(words: np.ndarray, i: int, j: int) -> int:
    """Number of equal words from i and j (i < j) on."""
    done, step = 0, 32
    while j + done < len(words):
        a, b = words[i + done:i + done + step], words[j + done:j + done + step]
        differ = np.flatnonzero(a[:len(b)] != b)
        if len(differ):
            return done + int(differ[0])
        done += len(b)
        step *= 2
    return done


def runs_of(word_ids: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers."""
    link, longest, states = _automaton(word_ids.tolist())
    paths = _Paths(link)
    back = word_ids[::-1]
    n = len(word_ids)
    until: dict[int, int] = {}  # period -> end of its last run
    out = []
    for i, state in enumerate(states):
        for deepest, last in paths.access(state, i):
            period = i - last
            size = longest[deepest] + period
            if last < 0 or size < exponent * period or size < length or until.get(period, 0) > i:
                continue
            end = i + 1 + _equal_ahead(word_ids, i + 1 - period, i + 1)
            first = i - size + 1
            start = first - _equal_ahead(back, n - first - period, n - first)
            until[period] = end
            out.append((start, end - start, period))
    return out


def find_runs(words: list[str], length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for start, end in candidate_blocks(hashes, length, exponent):
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words[start:end]), np.int64, end - start)
        out += [(start + s, n, q) for s, n, q in runs_of(ids, length, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def detect(docs: DataFrame, text: str = "text", key: str | None = None,
           prepare: Callable[[object, list[str]], list[str]] | None = None,
           length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``n_words`` long, ``runs`` (array of start, length, period by
    start, then period; words are numbered from 0) and ``collapsed`` string (the
    kept words, joined by one space).

    ``prepare`` may change a text's words first; it gets the column ``key`` too.
    NULL and empty texts have no words, no runs and an empty ``collapsed``.
    Repeated rows are treated each; all other columns stay, those named like the
    results are replaced; an empty table gives an empty one. Texts are whole;
    time grows with n log n of the words in candidate blocks, memory (about
    half a kilobyte a word) with the longest block of one text.
    """
    if length < GRAM + 1 or exponent < 4:
        raise ValueError("candidate blocks are exact from 6 words and 4 periods on")

    def run() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def add(batch: pa.RecordBatch) -> list[pa.Array]:
            keys = batch.column(1).to_pylist() if prepare else repeat(None)
            counts, found, texts = [], [], []
            for t, k in zip(batch.column(0).to_pylist(), keys):
                words = _WORDS.findall(t or "")
                if prepare:
                    words = prepare(k, words)
                runs = find_runs(words, length, exponent)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(" ".join(collapse(words, runs)))
            kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            return [pa.array(counts, pa.int64()), pa.array(found, pa.list_(kind)), pa.array(texts, pa.string())]

        return add

    inputs = [F.col(text), *([F.col(key)] if prepare else [])]
    return add_columns(docs, inputs, f"n_words long, runs {RUNS}, collapsed string", run)
