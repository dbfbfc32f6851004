"""N-gram Jaccard join by set-relation skipping.

Documents are sets of word shingles; two link if their Jaccard similarity
reaches a threshold. Equal sets are one class. A set that holds too many
shingles found nowhere else cannot link and leaves early. The others are
indexed by their rarest shingles: index lists are kept in blocks of similar set
size, and an entry's position skips the blocks that cannot reach the overlap.
Instead of all pairs of a list, each set is first compared with one leading set
of the list; sets that link to it share its component and are skipped together.
What is left, sets against blocks of another component's members, starts from
the answer for the block's pivot: members differ little from the pivot, so the
pivot's overlap bounds theirs and whole blocks are skipped unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, as_row, frugal, from_row, saved, scratch, small_side

SHINGLE = 5
PERCENT = 80
#: Share of the hash range whose shingles are counted over the whole corpus first.
REGION = 0.3
#: Members of a component that are searched together.
BLOCK = 256
#: Sets searched against a block in one task.
PROBES = 256
_FOLD = str.maketrans(UPPER, LOWER)
_WORDS = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS = 50_000


class _WordHashes(dict):
    """Hashes of words with A-Z folded, kept in a bounded cache."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.translate(_FOLD))
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text; of
    the whole word sequence, if it has fewer words; none without words."""
    words = _WORDS.findall(text or "")
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _nodes(docs: DataFrame) -> DataFrame:
    """``node, doc_id, text``: node is doc_id, or a hash where doc_id is NULL or
    comes with several texts (rows with one id and text are one node)."""
    text = F.xxhash64("text")
    stand_in = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit("node"))
    rows = docs.select("doc_id", "text")
    several = saved(rows.where("doc_id is not null").groupBy("doc_id")
                    .agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a != b")
                    .select(F.col("doc_id").alias("_several")), "ngram-ids")
    if several.isEmpty():
        node = F.when(F.col("doc_id").isNull(), stand_in).otherwise(F.col("doc_id"))
    else:
        rows = rows.join(several, F.col("doc_id") == F.col("_several"), "left")
        node = F.when(F.col("doc_id").isNull() | F.col("_several").isNotNull(), stand_in).otherwise(F.col("doc_id"))
    return rows.select(node.cast("long").alias("node"), "doc_id", "text")


def _sets(rows: DataFrame, size: int, region: float) -> DataFrame:
    """``node, doc_id, n, k1, k2, region``: size and 128-bit key of each text's
    shingle set, and its shingles in the lowest ``region`` of the hash range."""
    import xxhash

    top = int(-(1 << 63) + region * (1 << 64)) if region < 1 else (1 << 63) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, size) for t in pdf["text"]]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            out = pd.DataFrame({"node": pdf["node"], "doc_id": pdf["doc_id"], "n": [len(s) for s in sets],
                                "k1": halves[:, 0], "k2": halves[:, 1]})
            yield out.assign(region=[s[: np.searchsorted(s, top, "right")] for s in sets])
        _HASHES.clear()

    kind = rows.schema["doc_id"].dataType.simpleString()
    # ids that may be NULL travel as text: pandas would turn them into floats
    return (rows.select("node", F.col("doc_id").cast("string"), "text").mapInPandas(
        frugal(run), "node long, doc_id string, n long, k1 long, k2 long, region array<long>")
        .withColumn("doc_id", F.col("doc_id").cast(kind)))


def _unique_in_region(base: DataFrame) -> DataFrame:
    """``node, unique``: shingles of ``region`` that no other node holds. Needs
    no join: a shingle whose least and greatest node agree counts for that node."""
    return (base.select("node", F.explode("region").alias("token"))
            .groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
            .where("node = last").groupBy("node").agg(F.count("*").alias("unique")))


def _prefix(n: Column, percent: int) -> Column:
    """Rarest shingles of which a linked set must share one: n - least overlap + 1."""
    return n - F.ceil(n * percent / 100) + 1


def _indexed(suspects: DataFrame, percent: int) -> DataFrame:
    """``node, n, tokens``: the shingles that several suspects hold, rarest
    first, of the suspects whose prefix reaches into them."""
    tokens = suspects.select("node", "n", F.explode("tokens").alias("token"))
    shared = saved(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "ngram-df")
    return saved(tokens.join(shared, "token").groupBy("node", "n")
                 .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
                 .where(F.col("n") - F.size("t") < _prefix(F.col("n"), percent))
                 .select("node", "n", F.col("t.token").alias("tokens")), "ngram-indexed")


def _entries(live: DataFrame, percent: int) -> DataFrame:
    """The index: ``token, bucket, node, n, pos`` for every prefix shingle. The
    bucket is the logarithm of the size to the base 100 / percent, so linked
    sets lie in the same or in neighbouring buckets."""
    unique = F.col("n") - F.size("tokens")
    bucket = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    return (live.select("node", "n", unique.alias("u"), bucket.alias("bucket"), F.posexplode(
                F.slice("tokens", F.lit(1), (_prefix(F.col("n"), percent) - unique).cast("int"))).alias("k", "token"))
            .select("token", "bucket", "node", "n", (F.col("u") + F.col("k")).alias("pos")))


def _may_link(n: str, pos: str, m: str, m_pos: str, percent: int) -> Column:
    """Sizes within the threshold, and the shingles before the first common one,
    all unmatched, within the greatest symmetric difference of linked sets and
    few enough on either side to leave the least overlap."""
    n, pos, m, m_pos = map(F.col, (n, pos, m, m_pos))
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & ((100 + percent) * (pos + m_pos) <= (100 - percent) * (n + m))
            & _leaves_enough(n, pos, m, percent) & _leaves_enough(m, m_pos, n, percent))


def _leaves_enough(n: Column, pos: Column, m: Column, percent: int) -> Column:
    """What follows position ``pos`` of a set of ``n`` may be the overlap that a
    link with a set of ``m`` needs: n - pos >= percent (n + m) / (100 + percent)."""
    return 100 * n - (100 + percent) * pos >= percent * m


def _linked(n, m, overlap, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _leaders(entries: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """``node, parent``: each set and the leading set it links to. A list's
    leader is its least node; a set tries the leader it shares most lists with."""
    lead = (entries.groupBy("token", "bucket").agg(F.min(F.struct("node", "n", "pos")).alias("l"))
            .select("token", "bucket", F.col("l.node").alias("parent"), F.col("l.n").alias("m"), F.col("l.pos").alias("m_pos")))
    lead = saved(lead, "ngram-leaders")
    probe = entries.withColumn("home", F.col("bucket")).withColumn(
        "bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    tried = (probe.join(lead, ["token", "bucket"]).where("node != parent")
             .where(_may_link("n", "pos", "m", "m_pos", percent))
             .groupBy("node", "parent").agg(F.count("*").alias("c"))
             .groupBy("node").agg(F.max_by("parent", F.struct("c", -F.col("parent"))).alias("parent")))
    sides = live.select(F.col("node").alias("parent"), F.col("n").alias("m"), F.col("tokens").alias("other"))
    pairs = tried.join(sides, "parent").join(live.select("node", "n", "tokens"), "node")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(pdf["tokens"], pdf["other"])]
            ok = _linked(pdf["n"].to_numpy(), pdf["m"].to_numpy(), np.array(both, np.int64), percent)
            yield pdf.loc[ok, ["node", "parent"]]

    return pairs.select("node", "n", "tokens", "m", "other", "parent").mapInPandas(frugal(verify), "node long, parent long")


def _follow(parents: DataFrame, name: str) -> DataFrame:
    """``node, root`` of a forest by pointer doubling."""
    now = saved(parents.select("node", F.col("parent").alias("root")), name)
    while True:
        step = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        far = saved(now.join(step, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), name)
        now = far.select("node", "root")
        if far.where("moved").isEmpty():
            return now


class _Block:
    """Member sets as one index from shingle to members; the first is the pivot."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> None:
        self.sizes, self.percent = sizes, percent
        tokens = np.concatenate(sets)
        members = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.members = members[order]
        self.tokens, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.r_[self.first[1:], len(tokens)]
        self.pivot = np.sort(sets[0])
        self.far = int((sizes + sizes[0] - 2 * self.overlaps(sets[0])).max())

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        hit = at[self.tokens[at] == tokens]
        spans = [self.members[a:b] for a, b in zip(self.first[hit], self.last[hit])]
        return np.bincount(np.concatenate(spans) if spans else np.empty(0, np.int64), minlength=len(self.sizes))

    def links(self, n: int, tokens: np.ndarray) -> bool:
        """Whether any member links to a set. From the pivot's answer: a member
        is no closer than the pivot's distance less its own to the pivot."""
        common = len(np.intersect1d(self.pivot, tokens, assume_unique=True))
        if _linked(n, self.sizes[0], common, self.percent):
            return True
        distance = n + int(self.sizes[0]) - 2 * common
        if (100 + self.percent) * (distance - self.far) > (100 - self.percent) * (n + int(self.sizes.max())):
            return False
        return bool(_linked(n, self.sizes, self.overlaps(tokens), self.percent).any())


def _cross_links(entries: DataFrame, live: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of components between which some pair of sets links.

    The set of the smaller component probes; the lists are reduced to a row per
    (shingle, bucket, component) first, so a list of one component costs nothing.
    """
    at = live.select("node", "n", "tokens").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    at = saved(at, "ngram-labelled")
    sizes = at.groupBy("comp").agg(F.count("*").alias("members"))
    labels = at.select("node", "comp").join(sizes, "comp")
    marked = saved(entries.join(labels, "node"), "ngram-entries")
    mixed = (marked.select("token", "comp").groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
             .where("a != b").select("token"))
    marked = marked.join(saved(mixed, "ngram-mixed"), "token")
    groups = (marked.groupBy("token", "bucket", "comp", "members")
              .agg(F.min("n").alias("least"), F.max("n").alias("m"), F.min("pos").alias("m_pos"))
              .withColumnsRenamed({"comp": "other", "members": "others"}))
    probe = marked.withColumnRenamed("bucket", "home").withColumn("bucket", F.explode(
        F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    smaller = F.struct("members", "comp") < F.struct(F.col("others").alias("members"), F.col("other").alias("comp"))
    near = ((100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("m") >= percent * F.col("n"))
            & ((100 + percent) * (F.col("pos") + F.col("m_pos")) <= (100 - percent) * (F.col("n") + F.col("m")))
            & _leaves_enough(F.col("n"), F.col("pos"), F.col("least"), percent)
            & _leaves_enough(F.col("m"), F.col("m_pos"), F.col("n"), percent))
    met = probe.join(groups, ["token", "bucket"]).where(smaller & near)
    # between two single sets the prefix tells how much may still follow the last common shingle
    most = F.col("c") + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("m_pos") - 1)
    asked = (met.groupBy("node", "n", "home", "comp", "other", "others")
             .agg(F.count("*").alias("c"), F.max("pos").alias("pos"), F.max("m").alias("m"), F.max("m_pos").alias("m_pos"))
             .where((F.col("others") > 1) | ((100 + percent) * most >= percent * (F.col("n") + F.col("m"))))
             .select("node", "n", "home", "comp", "other"))
    asked = saved(asked, "ngram-asked")

    bucket = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    wanted = asked.select(F.col("other").alias("comp")).distinct()
    members = at.join(wanted, "comp").withColumn("bucket", bucket)
    parts = saved(members.groupBy("comp", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "ngram-parts")
    probes = (asked.join(parts.withColumnRenamed("comp", "other"), "other")
              .where(F.abs(F.col("home") - F.col("bucket")) <= 1)
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    load = saved(probes.groupBy("other", "bucket", "part").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("shares")), "ngram-load")
    probes = (probes.join(load, ["other", "bucket", "part"])
              .withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares").cast("long")).cast("int"))
              .join(live.select("node", "tokens"), "node")
              .select("other", "bucket", "part", "share", "comp", "n", "tokens"))
    held = (members.join(parts, ["comp", "bucket"])
            .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
            .withColumnRenamed("comp", "other").join(load, ["other", "bucket", "part"])
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            .select("other", "bucket", "part", "share", "node", "n", "tokens"))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        right = right.sort_values(["n", "node"])
        block = _Block(right["n"].to_numpy(np.int64), list(right["tokens"]), percent)
        found = {c for c, n, t in zip(left["comp"], left["n"], left["tokens"]) if block.links(n, t)}
        return pd.DataFrame({"a": list(found), "b": [key[0]] * len(found)})

    keys = ["other", "bucket", "part", "share"]
    return (probes.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "a long, b long").distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the least node of
    its component, by least labels along edges and pointer jumping."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .distinct(), name)
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    label = saved(label, name)
    while True:
        seen = (both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        new = (label.join(seen, "node").join(jump, "root", "left")
               .select("node", F.least("root", "near", F.coalesce("jump", "root")).alias("new"), "root"))
        new = saved(new.select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")), name)
        label = new.select("node", "root")
        if new.where("moved").isEmpty():
            return label


def ngram_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, region: float = REGION) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id, class_rows`` for every row of
    ``docs`` (``doc_id, text``; other columns are ignored).

    A-Z is folded and words are runs of characters other than blanks and
    U+0009..U+000D. Two rows link if 100 x common >= ``percent`` x all of their
    shingles; ``component_id`` is the smallest doc_id that links reach. A text
    without words (or NULL) has no shingles and links with nothing. A row with
    NULL doc_id links like any other but gives no component its id (NULL, if it
    reaches none). Rows that repeat an id are linked each by its own text, the
    id itself being reached if one of them is. ``class_rows`` counts the rows
    with the same set. Shingles are compared by 64-bit hashes.
    """
    with scratch(docs.sparkSession) as keep:
        rows = _nodes(docs)
        base = keep(saved(_sets(rows, size, region), "ngram-docs"))
        answer = keep(saved(_answers(rows, base, size, percent), "ngram-answers"))
    return (base.join(answer, ["k1", "k2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows")))


def _answers(rows: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame:
    """``k1, k2, class_rows, component_id`` of every class of equal sets."""
    classes = saved(base.where("n > 0").groupBy("k1", "k2", "n")
                    .agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("class_rows")),
                    "ngram-classes")
    unique = _unique_in_region(base)
    suspect = saved(classes.select("node", "n").join(unique, "node", "left")
                    .where(F.coalesce("unique", F.lit(0)) < _prefix(F.col("n"), percent)).select("node"), "ngram-suspects")
    kept = rows.join(small_side(suspect), "node", "left_semi")
    sets = saved(_sets(kept, size, 1).dropDuplicates(["node"]).withColumnRenamed("region", "tokens"), "ngram-sets")

    live = _indexed(sets, percent)
    entries = saved(_entries(live, percent), "ngram-index")
    roots = _follow(_leaders(entries, live, percent), "ngram-roots")
    edges = saved(_cross_links(entries, live, roots, percent), "ngram-links")
    joined = components(edges)
    label = (roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
             .select("node", F.coalesce("far", "root").alias("root"))
             .unionByName(joined.join(roots, "node", "left_anti")))
    label = saved(label.unionByName(label.select(F.col("root").alias("node"), "root")).distinct(), "ngram-labels")
    # the smallest doc_id of each component
    named = classes.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("least is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root", "left").select("k1", "k2", "class_rows", "component_id")


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, each
    id and text once. Rows with a NULL doc_id stay: they have no place in the
    order of ids."""
    found = saved(ngram_components(docs, **options).select("doc_id", "component_id").where("doc_id is not null"),
                  "ngram-found")
    gone = found.where("not doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id"))
    gone = gone.join(stay, "_id", "left_anti")
    # the document travels as one value, so its columns cannot clash with the ids
    row, same = docs.select(as_row(docs.columns), "doc_id", "text"), F.col("doc_id") == F.col("_id")
    out = row.join(small_side(saved(gone, "ngram-gone")), same, "left_anti")
    again = saved(stay.groupBy("_id").count().where("count > 1").select("_id"), "ngram-again")
    if not again.isEmpty():
        again = small_side(again)
        first = out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(again, same, "left_anti").unionByName(first)
    return out.select(*from_row(docs.columns))
