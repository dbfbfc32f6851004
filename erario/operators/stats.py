"""Exact percentiles by counting selection: no sort, no group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here each wanted rank of a group has a range of values that
holds it, at first the group's least to greatest. A round cuts the range into
buckets, counts the rows of each (combined on the map side, so what is shuffled
is bounded by groups x ranks x buckets a task, whatever the group's size) and
goes on with the least and greatest value of the bucket that holds the rank,
until they are equal. For linear interpolation

    h = (n - 1) * p,  value = v[floor h] + (h - floor h) * (v[ceil h] - v[floor h])

(0-based positions in ascending order; the definition of ``quantile_cont`` /
``percentile``) two ranks a percentile are selected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.operators.upsert import stage

BUCKETS = 1024


def pct_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def bucket_of(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """0 for the least value, ``buckets`` for the greatest, 1 .. buckets - 1 in
    between, never falling while ``v`` rises. Least and greatest get buckets of
    their own, so every round leaves a smaller range; where an end is infinite
    or NaN the others share bucket 1."""
    # halves: the width of a range of finite values stays finite; it may be too small to tell from 0
    at = F.floor(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2) * (buckets - 2))
    plain = lo.isin(float("-inf"), float("inf")) | hi.isin(float("inf"), float("-inf")) | F.isnan(lo) | F.isnan(hi)
    between = F.least(F.greatest(1 + at, F.lit(1)), F.lit(buckets - 1))
    return F.when(v == lo, 0).when(v == hi, buckets).when(plain, 1).otherwise(between).cast("int")


def select_ranks(rows: DataFrame, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``key, rank, value``: the value at each 0-based ``rank`` of a key.

    ``rows``: ``key, v`` (double, no NULLs); ``wanted``: ``key, rank, lo, hi``
    with the key's least and greatest value, ranks within the key's rows.
    """
    now = stage(wanted.withColumn("left", F.col("rank")), "ranks")
    while not now.where("lo < hi").isEmpty():
        ranges = now.where("lo < hi").select("key", "lo", "hi").distinct()
        inside = rows.join(ranges, "key").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        counts = (inside.groupBy("key", "lo", "hi", bucket_of(F.col("v"), F.col("lo"), F.col("hi"), buckets).alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
        upto = Window.partitionBy("key", "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
        step = (now.where("lo < hi").join(found, ["key", "lo", "hi"])
                .where((F.col("left") >= F.col("begin")) & (F.col("left") < F.col("end")))
                .select("key", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"),
                        (F.col("left") - F.col("begin")).alias("left")))
        now = stage(step.unionByName(now.where("not lo < hi")), "ranks")
    return now.select("key", "rank", F.col("lo").alias("value"))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float],
                      buckets: int = BUCKETS) -> DataFrame:
    """One row per group with a value: ``p50``, ``p90``, ... of ``value`` as
    double (NULLs ignored, NaN is the greatest value). NULL group keys are a
    group. The groups and their values are staged once, every round reads them."""
    by = list(by)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("end")).alias("key")
    rows = stage(df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v")), "values")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    h = {p: (F.col("n") - 1).cast("double") * F.lit(float(p)) for p in ps}
    ranks = F.array_distinct(F.array(*[f(h[p]).cast("long") for p in ps for f in (F.floor, F.ceil)]))
    wanted = groups.select("key", F.explode(ranks).alias("rank"), "lo", "hi")
    at = select_ranks(rows, wanted, buckets)
    joined = at.join(groups.select("key", "n"), "key")
    picked = joined.groupBy("key").agg(F.max("n").alias("n"), F.map_from_entries(
        F.collect_list(F.struct("rank", "value"))).alias("at"))  # at most two ranks a percentile
    out = []
    for p in ps:
        lo, hi = (F.element_at("at", f(h[p]).cast("long")) for f in (F.floor, F.ceil))
        out.append((lo + (h[p] - F.floor(h[p])) * (hi - lo)).alias(pct_name(p)))
    return picked.select(*[F.col("key")[f"k{i}"].alias(c) for i, c in enumerate(by)], *out)
