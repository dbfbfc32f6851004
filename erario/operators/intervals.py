"""Joins by intervals and counts by dominance without pairs of a nested loop.

``overlap_join``: an interval is cut into the O(log length) aligned cells of
sizes 1, 2, 4, ... that cover it exactly; a point lies in one cell of each size.
Two intervals overlap if the later start lies in the other interval, and of the
cells that cover this one exactly one holds the point. So an equi-join on (key,
size, cell) gives every pair once, whatever the lengths, and a hot key is spread
over its cells.

``earlier_higher``: for each row the rows of its key with an earlier time and a
higher value, as the correlated subquery would count them. The rows of a key with
few are compared in one array. Of the other keys, times that differ agree down to
one digit, where the earlier has the smaller: per digit the rows of equal higher
digits are merged by value, and each asks for those of smaller digits above it.
Output and work are n and n log(times), not pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.operators.upsert import stage
from erario.operators.windows import over_buckets

#: Keys of up to this many rows are compared row by row.
FEW = 128
#: Bits of a time taken at once: each row is there once for every digit of its time.
DIGIT = 2


def _down(c: Column, bits: Column) -> Column:
    return F.call_function("shiftright", c, bits)


def cover(lo: Column, hi: Column, levels: int) -> Column:
    """Cells ``(level, cell)`` of the closed interval lo..hi: at each level the
    first cell if it is odd and the last if it is even, as neither has its
    neighbour inside; empty if lo > hi or either is NULL."""
    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, end = _down(lo + size - 1, k), _down(hi + 1, k)  # whole cells first .. end - 1
        odd = first.bitwiseAND(F.lit(1).cast("long"))
        left = F.when((first < end) & (odd == 1), F.struct(k.alias("level"), first.alias("cell")))
        right = F.when((first + odd < end) & (end.bitwiseAND(F.lit(1).cast("long")) == 1),
                       F.struct(k.alias("level"), (end - 1).alias("cell")))
        return F.array(left, right)

    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
    return F.when(lo <= hi, F.filter(cells, lambda c: c.isNotNull()))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                 on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows with equal ``on`` columns whose closed intervals of whole
    numbers overlap, each once, as two structs ``left`` and ``right``.

    An interval with a NULL end, or that ends before it starts, overlaps
    nothing; NULL keys are equal to nothing. Repeated rows give repeated pairs.
    """
    def side(df: DataFrame, span: tuple[str, str], name: str, keys: list[str]) -> DataFrame:
        lo, hi = (F.col(c).cast("long") for c in span)
        key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.lit(0).alias("end"))
        known = lo <= hi
        for c in keys:
            known = known & F.col(c).isNotNull()
        return df.where(known).select(F.struct("*").alias(name), key.alias("key"), lo.alias("lo"), hi.alias("hi"))

    a = side(left, left_span, "left", [l for l, _ in on])
    b = side(right, right_span, "right", [r for _, r in on])
    longest = F.max(F.col("hi") - F.col("lo"))
    most = a.agg(longest).unionByName(b.agg(longest)).agg(F.max("max((hi - lo))")).first()[0]
    levels = (most or 0).bit_length() + 1

    def within(spans: DataFrame, points: DataFrame, name: str, other: str, lo: Column) -> DataFrame:
        """Intervals lo..hi of ``spans`` with the starts of ``points`` inside."""
        cells = spans.select(name, "key", F.inline(cover(lo, F.col("hi"), levels)))
        level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
        at = points.select(other, "key", "lo", level).select(other, "key", "level", _down(F.col("lo"), F.col("level")).alias("cell"))
        # the planner takes the cells for as few as the rows they come from: never broadcast
        return cells.join(at.hint("merge"), ["key", "level", "cell"]).select("left", "right")

    # equal starts belong to the first case alone
    return within(a, b, "left", "right", F.col("lo")).unionByName(within(b, a, "right", "left", F.col("lo") + 1))


def _by_digits(known: DataFrame, first: int, last: int) -> DataFrame:
    """``id, n`` of the rows ``key, t, v, b, id`` that have any earlier, higher one."""
    levels = max(-(-(last - first).bit_length() // DIGIT), 1)
    t = F.col("t") - F.lit(first)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    top = (1 << DIGIT) - 1
    asked = known.select("key", "v", "b", "id", t.alias("t"), level).select(
        "key", "v", "b", "id", "level", _down(F.col("t"), (F.col("level") + 1) * DIGIT).alias("cell"),
        _down(F.col("t"), F.col("level") * DIGIT).bitwiseAND(F.lit(top).cast("long")).alias("digit"))
    asked = asked.withColumns({f"below{d}": (F.col("digit") < d).cast("long") for d in range(1, top + 1)})
    # of equal values those of later digits come first, so they do not count their equals
    merged = over_buckets(asked, ["key", "level", "cell"], [("v", False), ("digit", False), "id"], F.col("b"),
                          running={f"above{d}": f"below{d}" for d in range(1, top + 1)})
    above = reduce(lambda c, d: c.when(F.col("digit") == d, F.col(f"above{d}")), range(1, top + 1), F)
    return merged.select("id", above.alias("above")).where("above > 0").groupBy("id").agg(F.sum("above").alias("n"))


def earlier_higher(df: DataFrame, by: Sequence[str], time: str, value: str, bucket: Column,
                   out: str = "earlier_higher") -> DataFrame:
    """``df`` with ``out``: the number of rows of the same key with a smaller
    ``time`` (a whole number) and a greater ``value``.

    NULL time or value is neither counted nor counts anything (0); NULL keys are
    a key of their own. Equal times or values do not count. ``bucket`` is a
    function of ``value`` that never falls while it rises; rows of one key and
    value bucket share a task. The table is staged once, so its rows can be named.
    """
    rest = [c for c in df.columns if c != out]
    rows = stage(df.select(
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("end")).alias("row"),
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("end")).alias("key"),
        F.col(time).cast("long").alias("t"), F.col(value).alias("v"), bucket.alias("b"),
        F.monotonically_increasing_id().alias("id")), "dominance")
    known = rows.where("t is not null and v is not null")
    # a key of few rows is one array, whose pairs are compared; only the others are cut by digits
    many = known.groupBy("key").count().where(F.col("count") > FEW).select("key")
    lists = (known.join(many, "key", "left_anti").groupBy("key")
             .agg(F.collect_list(F.struct("t", "v", "id")).alias("all")))
    few = lists.select(F.inline(F.transform("all", lambda r: F.struct(r["id"].alias("id"), F.size(F.filter(
        "all", lambda o: (o["t"] < r["t"]) & (o["v"] > r["v"]))).cast("long").alias("n")))))
    hot = known.join(many, "key", "left_semi")
    first, last = hot.agg(F.min("t"), F.max("t")).first()
    counts = few.where("n > 0")
    if first is not None:
        counts = counts.unionByName(_by_digits(hot, first, last))
    return (rows.join(counts, "id", "left")
            .select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(rest)], F.coalesce("n", F.lit(0)).cast("long").alias(out)))
