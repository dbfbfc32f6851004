"""Window functions over a key by order buckets.

``Window.partitionBy(key)`` puts all rows of a key into one task. Here the rows
of a key are dealt to buckets that follow the order (a month of a date, a
hundred turns): Spark's own ``Window`` runs per (key, bucket), an aggregate
keeps one row per (key, bucket) with its number of rows, sums and edge rows, and
a window over these few rows per key gives what lies before and after each
bucket. The totals are joined back on (key, bucket), the partitioning the rows
already have, so a key that holds a third of the rows is spread over its buckets
and costs no second shuffle.

Everything is built-in expressions; nothing is written or checkpointed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = str | tuple[str, bool]


def _sort(column: Column, ascending: bool) -> Column:
    return column.asc_nulls_first() if ascending else column.desc_nulls_last()


def over_buckets(df: DataFrame, by: Sequence[str], order: Sequence[Order], bucket: Column, *,
                 ties: int | None = None, running: Mapping[str, str] | None = None,
                 lag: Mapping[str, str] | None = None, lead: Mapping[str, str] | None = None,
                 first: Mapping[str, str] | None = None, nth: Mapping[str, tuple[str, int]] | None = None,
                 last: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``row_number``, ``rank``, ``dense_rank``, ``tie_rows`` (rows of
    equal order value), ``group_rows`` (rows of the key), all long, and

    * ``running``: result -> column, its sum up to this row (NULL counts as 0);
    * ``lag``, ``lead``, ``first``, ``last``: result -> column, the value of the
      row before, after, of the key's first and last row;
    * ``nth``: result -> (column, n), the value of the key's n-th row, NULL
      before it is reached.

    ``order`` lists columns or (column, ascending); NULLs come first rising and
    last falling. The first ``ties`` columns (default: all) make up the order
    value of the ranks; all of them should be a total order, else rows of equal
    order stand in any order. ``bucket`` must be a function of the first order
    column that never falls while that column rises, and all rows of one
    (key, bucket) must fit a task. NULL keys are a key of their own. Columns
    named like a result are replaced; an empty table gives an empty one.
    """
    spec = [(o, True) if isinstance(o, str) else (o[0], bool(o[1])) for o in order]
    tied = [c for c, _ in spec[:len(spec) if ties is None else ties]]
    running, lag, lead = dict(running or {}), dict(lag or {}), dict(lead or {})
    first, nth, last = dict(first or {}), dict(nth or {}), dict(last or {})
    made = ["row_number", "rank", "dense_rank", "tie_rows", "group_rows", *running, *lag, *lead, *first, *nth, *last]
    kept = [c for c in df.columns if c not in made]

    # the row and its parts are fields named by us: nothing of the table can clash
    edge = sorted({*lag.values(), *lead.values(), *first.values(), *last.values(), *(c for c, _ in nth.values())})
    place = {c: f"e{i}" for i, c in enumerate(edge)}
    rows = df.select(
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("end")).alias("key"),
        F.struct(bucket.alias("b")).alias("bucket"),
        *[F.col(c).alias(f"o{i}") for i, (c, _) in enumerate(spec)],
        *[F.coalesce(F.col(c), F.lit(0)).alias(f"s{i}") for i, c in enumerate(running.values())],
        F.struct(*[F.col(c).alias(f) for c, f in place.items()], F.lit(0).alias("end")).alias("edge"))
    sorts = [_sort(F.col(f"o{i}"), up) for i, (_, up) in enumerate(spec)]
    value = [f"o{i}" for i in range(len(tied))]

    inside = Window.partitionBy("key", "bucket")
    here = inside.orderBy(*sorts)
    up_to = here.rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.orderBy(*sorts[:len(tied)])
    local = rows.withColumns({
        "n": F.row_number().over(here).cast("long"), "r": F.rank().over(ranked).cast("long"),
        "d": F.dense_rank().over(ranked).cast("long"),
        **{f"run{i}": F.sum(f"s{i}").over(up_to) for i in range(len(running))},
        **({"before": F.lag("edge").over(here)} if lag else {}),
        **({"after": F.lead("edge").over(here)} if lead else {})})
    local = local.withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("key", "bucket", *value)))

    # one row a bucket: its size, sums and edge rows
    wanted = sorted({n for _, n in nth.values()} | {1})
    totals = local.groupBy("key", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.max("d").alias("values"),
        *[F.sum(f"s{i}").alias(f"sum{i}") for i in range(len(running))],
        F.max(F.when(F.col("n") == 1, F.col("edge"))).alias("head"),
        F.max_by("edge", "n").alias("tail"))
    buckets = Window.partitionBy("key").orderBy(_sort(F.col("bucket.b"), spec[0][1]))
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    whole = buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(c: str) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    bases = totals.select(
        "key", "bucket", before("rows").alias("rows0"), before("values").alias("values0"),
        *[before(f"sum{i}").alias(f"sum0_{i}") for i in range(len(running))],
        F.lag("tail").over(buckets).alias("tail0"), F.lead("head").over(buckets).alias("head1"),
        F.first("head").over(whole).alias("head0"), F.last("tail").over(whole).alias("tail1"),
        F.sum("rows").over(whole).alias("group_rows"))
    joined = local.join(bases, ["key", "bucket"])
    number = F.col("rows0") + F.col("n")
    out = {"row_number": number, "rank": F.col("rows0") + F.col("r"), "dense_rank": F.col("values0") + F.col("d"),
           "tie_rows": F.col("t"), "group_rows": F.col("group_rows")}
    out |= {name: F.col(f"sum0_{i}") + F.col(f"run{i}") for i, name in enumerate(running)}
    out |= {name: F.when(F.col("n") == 1, F.col("tail0")).otherwise(F.col("before"))[place[c]] for name, c in lag.items()}
    out |= {name: F.coalesce(F.col("after"), F.col("head1"))[place[c]] for name, c in lead.items()}
    out |= {name: F.col("head0")[place[c]] for name, c in first.items()}
    out |= {name: F.col("tail1")[place[c]] for name, c in last.items()}
    if nth:
        # the n-th row of a key lies in some bucket: one row a key and n, joined back
        at = (joined.where(number.isin(wanted)).groupBy("key")
              .agg(*[F.max(F.when(number == n, F.col("edge"))).alias(f"nth{n}") for n in wanted]))
        joined = joined.join(at, "key", "left")
        out |= {name: F.when(number >= n, F.col(f"nth{n}")[place[c]]) for name, (c, n) in nth.items()}
    return joined.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)],
                         *[v.alias(name) for name, v in out.items()])


def ntile(n: int) -> Column:
    """``ntile(n)`` from ``row_number`` and ``group_rows``: the first groups are
    one row longer where the rows do not divide evenly."""
    rows, at = F.col("group_rows"), F.col("row_number") - 1
    size, more = F.floor(rows / n), rows % n
    long_part = more * (size + 1)
    return F.when(at < long_part, F.floor(at / (size + 1))).otherwise(
        more + F.floor((at - long_part) / F.greatest(size, F.lit(1)))).cast("long") + 1


def percent_rank() -> Column:
    """``percent_rank()`` from ``rank`` and ``group_rows``."""
    return F.when(F.col("group_rows") > 1, (F.col("rank") - 1) / (F.col("group_rows") - 1)).otherwise(F.lit(0.0))


def cume_dist() -> Column:
    """``cume_dist()`` from ``rank``, ``tie_rows`` and ``group_rows``."""
    return (F.col("rank") + F.col("tie_rows") - 1) / F.col("group_rows")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that matches NULL with NULL; the key columns of
    ``left`` and the other columns of both are returned."""
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    joined = left.join(right, on, how)
    for k in keys:
        joined = joined.drop(right[k])
    return joined
