"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and their words laid end to end;
this stream is cut into equal blocks. The van der Corput points
``reverse_bits(i) / 2^k`` are mapped through the cumulative slot counts of the
sources, which gives the source of slot ``i``; the slot's rank among its
source's slots names the block it takes (past the last block a new pass over
the source starts). Because bit reversal visits every integer once, each source
gets exactly the number of slots that its target needs, and any stretch of
slots holds each source in its share but for about k slots. The mix is a stream
in slot order: a document stands at the first slot of each pass that takes any
of its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, from_row, running_total, saved, small_side, word_count

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 256
MIN_BLOCKS = 1024


def source_targets(sized: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Sources in code point order (NULL last) take the weights in turn and share
    all words in proportion; a target stops at ``passes`` times its source's
    size and the excess goes to the others by weight. Sorted by cap per weight,
    a source is capped if its cap is at most its share of what the ones before
    it leave; so one ordered pass over the (small) table of sources settles it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", passes * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything)
                               - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / F.sum("weight").over(rest))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    s = s.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"),
                                                                     F.col("source").isNull(), "source", "level")))
                     .over(everything)["level"])
    return s.select("source", "source_size", "weight",
                    F.when(F.col("capped"), F.col("cap").cast("double"))
                    .otherwise(F.col("level") * F.col("weight")).alias("target"))


def _plan(targets: DataFrame, passes: int, block: int, min_blocks: int) -> DataFrame:
    """Add the block width, blocks, slots and first point of each source."""
    t = targets.withColumn("source_no", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    size = F.col("source_size")
    width = F.least(F.lit(block), F.greatest(F.lit(1), F.ceil(size / min_blocks))).cast("long")
    t = t.withColumn("width", width).withColumn("blocks", F.ceil(size / F.col("width")).cast("long"))
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    part = F.round((F.col("target") - whole * size) / F.col("width")).cast("long")
    slots = whole * F.col("blocks") + F.least(part, F.col("blocks"))
    t = t.withColumn("slots", F.least(slots, passes * F.col("blocks")))
    every = Window.orderBy("source_no")
    t = t.withColumn("first", F.coalesce(F.sum("slots").over(
        every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("slots").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.withColumn("bits", F.length(F.bin(F.greatest(total - 1, F.lit(1)))))


def schedule(plan: DataFrame, chunk: int = 1 << 15) -> DataFrame:
    """Rows ``slot, source_no, rank, pass, block`` of the mix, by slot.

    A source's points are laid out in pieces of at most ``chunk``, so a source
    with a third of all slots is many rows before it is unrolled.
    """
    last = F.col("first") + F.col("slots") - 1
    pieces = (plan.where("slots > 0")
              .withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / chunk).cast("long"),
                                                        F.floor(last / chunk).cast("long"))))
              .withColumn("lo", F.greatest("first", F.col("piece") * chunk))
              .withColumn("hi", F.least(last, (F.col("piece") + 1) * chunk - 1))
              .select("source_no", "blocks", "bits", "piece", "lo", "hi")
              .repartition("source_no", "piece"))
    point = pieces.withColumn("point", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi", "piece")
    flipped = F.conv(F.reverse(F.expr("lpad(bin(point), bits, '0')")), 2, 10).cast("long")
    slots = point.withColumn("slot", flipped).drop("point")
    slots = slots.withColumns({"one": F.lit(1).cast("long"),
                               "part": F.expr("shiftright(slot, cast(bits / 2 as int))")})
    ranked = running_total(slots, "source_no", "part", [F.col("slot")], "one", "rank")
    return ranked.select("slot", "source_no", "rank", F.floor(F.col("rank") / F.col("blocks")).alias("pass"),
                         (F.col("rank") % F.col("blocks")).alias("block"))


def _row_key(docs: DataFrame) -> Column:
    """128 bits of all columns: rows of one key are equal and interchangeable."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK_WORDS,
                min_blocks: int = MIN_BLOCKS, seed: int = 0) -> DataFrame:
    """Return ``doc_id, source, size, source_size, target, start, taken, slots``
    for every row of ``docs`` (``doc_id, text, source``, other columns ignored).

    ``size`` counts words (NULL text: 0); ``start`` is the document's place in
    its source's shuffled stream, ``taken`` the words that the scheduled blocks
    take of it, repeats counted, and ``slots`` the places in the mix at which
    the passes that take any of them reach it, rising. A document without words
    takes part with ``taken`` 0 and no slots. NULL is a source of its own, last
    in order. Repeated rows are separate documents. The shuffle hashes doc_id
    with ``seed`` and blocks follow by rank, so reruns agree. An empty table
    gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).alias("row_key"))
    return _mixed(rows, weights, passes, block, min_blocks, seed).drop("row_key")


def _mixed(rows: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK_WORDS,
           min_blocks: int = MIN_BLOCKS, seed: int = 0) -> DataFrame:
    """``mix_sources`` of rows ``doc_id, source, size, row_key``; carries row_key."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))
    sized = saved(rows.withColumn("key", key), "mix-sizes")
    digits = max(2, math.ceil(math.log(max(sized.count(), 2), 16) / 2))
    targets = saved(_plan(source_targets(sized, weights, passes), passes, block, min_blocks), "mix-sources")

    rows = (sized.join(targets.select("source", "source_no", "source_size", "target", "width"),
                       sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
            .withColumn("part", F.substring("key", 1, digits)))
    placed = running_total(rows, "source_no", "part", [F.col("key"), F.col("size"), F.col("row_key")], "size", "start")
    placed = placed.drop("key", "part")
    end = F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("width")).cast("long"), F.floor((end - 1) / F.col("width")).cast("long"))))
    here = (F.least(end, (F.col("block") + 1) * F.col("width"))
            - F.greatest("start", F.col("block") * F.col("width")))
    # (source, start) is one document: those without words are not here
    facts = ["doc_id", "source", "size", "source_size", "target", "row_key"]
    taken = (cut.withColumn("here", here).join(schedule(targets).hint("merge"), ["source_no", "block"], "left")
             .groupBy("source_no", "start", "pass", *facts)
             .agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("here"))).alias("taken"), F.min("slot").alias("slot"))
             .groupBy("source_no", "start", *facts)
             .agg(F.coalesce(F.sum("taken"), F.lit(0)).cast("long").alias("taken"),
                  F.array_sort(F.collect_list("slot")).alias("slots")))  # at most one a pass
    cols = ["doc_id", "source", "size", "source_size", "target", "start", "taken", "slots", "row_key"]
    return taken.select(*cols).unionByName(placed.where("size = 0").withColumns(
        {"taken": F.lit(0).cast("long"), "slots": F.array().cast("array<long>")}).select(*cols))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once for every pass that takes any of
    its words (whole texts; rows that no pass takes go), as a stream in slot
    order (ranges of slots by partition, sorted inside).

    Copies belong to rows, not to ids: rows of one doc_id (or none) from several
    sources go by their own source's passes. Rows equal in all columns are
    interchangeable; they go into the stream as one row with all their slots.
    """
    keyed = docs.select(as_row(docs.columns), "doc_id", "source", word_count(F.col("text")).alias("size"),
                        _row_key(docs).alias("row_key"))
    mixed = saved(_mixed(keyed.drop("row"), **options).select("row_key", "slots"), "mix-slots")
    counts = mixed.groupBy("row_key").agg(F.count("*").alias("rows"), F.max("slots").alias("slots"))
    equal = saved(counts.where("rows > 1").select("row_key"), "mix-equal")
    single = saved(counts.where("rows = 1 and size(slots) > 0").select("row_key", "slots"), "mix-single")
    stream = keyed.select("row", "row_key").join(small_side(single, "slots"), "row_key").withColumn("slot", F.explode("slots"))
    if not equal.isEmpty():
        equal = small_side(equal)
        # a third of all rows may be equal: one row of them is kept by a partial aggregation first
        one = (keyed.select("row", "row_key").join(equal, "row_key", "left_semi")
               .groupBy("row_key").agg(F.first("row").alias("row")))
        slots = mixed.join(equal, "row_key", "left_semi").select("row_key", F.explode("slots").alias("slot"))
        stream = stream.select("row", "slot").unionByName(slots.join(one, "row_key").select("row", "slot"))
    return (stream.select("row", "slot").repartitionByRange("slot").sortWithinPartitions("slot")
            .select(*from_row(docs.columns)))
