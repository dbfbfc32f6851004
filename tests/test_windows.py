"""Windows by order buckets equal Spark's plain windows; percentiles by counting
selection equal a sort. One key holds over a third of the rows; there are ties,
NULL keys, NULL order values and rows equal in every column."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from erario.operators.stats import bucket_of, exact_percentiles
from erario.operators.windows import cume_dist, ntile, over_buckets, percent_rank


def _data(spark, seed, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < 0.4 else None if rnd.random() < 0.2 else rnd.randint(1, 30)
        v = rnd.randint(-20, 40) if rnd.random() < 0.9 else None
        rows.append((k, v, i, rnd.randint(-500, 500) if rnd.random() < 0.8 else None))
    return spark.createDataFrame(rows, "k int, v int, id long, cents long")


def _same(a, b):
    a, b = sorted(map(tuple, a.collect()), key=str), sorted(map(tuple, b.collect()), key=str)
    assert len(a) == len(b) and [(x, y) for x, y in zip(a, b) if x != y][:3] == []


@pytest.mark.parametrize("seed, width, up", [(1, 7, True), (2, 1, True), (3, 1000, True), (4, 7, False), (5, 3, False)])
def test_buckets_match_plain_windows(spark, seed, width, up):
    df = _data(spark, seed)
    got = over_buckets(df, ["k"], [("v", up), "id"], F.floor(F.col("v") / width), ties=1, running={"total": "cents"},
                       lag={"prev": "cents", "prev_v": "v"}, lead={"next": "cents"}, first={"head": "cents"},
                       last={"tail": "cents"}, nth={"third": ("cents", 3)})
    got = got.select("id", "row_number", "rank", "dense_rank", "tie_rows", "group_rows", "total", "prev", "prev_v", "next",
                     "head", "tail", "third", ntile(4).alias("nt"), percent_rank().alias("pr"), cume_dist().alias("cd"))
    v = F.col("v").asc_nulls_first() if up else F.col("v").desc_nulls_last()
    w, wr = Window.partitionBy("k").orderBy(v, "id"), Window.partitionBy("k").orderBy(v)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    _same(got, df.select(
        "id", F.row_number().over(w), F.rank().over(wr), F.dense_rank().over(wr),
        F.count("*").over(Window.partitionBy("k", "v")), F.count("*").over(Window.partitionBy("k")),
        F.sum(F.coalesce("cents", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.lag("cents").over(w), F.lag("v").over(w), F.lead("cents").over(w), F.first("cents").over(every),
        F.last("cents").over(every), F.nth_value("cents", 3).over(w), F.ntile(4).over(w),
        F.percent_rank().over(wr), F.cume_dist().over(wr)))


def test_global_order_strings_and_clashing_names(spark):
    df = _data(spark, 9, 700).selectExpr("cast(v as string) AS rank", "id AS key", "cents AS bucket", "k AS row", "id AS n", "k AS edge")
    got = over_buckets(df, [], ["rank", "key"], F.substring("rank", 1, 1), ties=1, lag={"prev": "bucket"})
    assert "edge" in got.columns and "row" in got.columns
    w = Window.orderBy(F.col("rank").asc_nulls_first(), "key")
    exp = df.select("key", F.row_number().over(w), F.rank().over(Window.orderBy(F.col("rank").asc_nulls_first())),
                    F.lag("bucket").over(w), "row", "edge")
    _same(got.select("key", "row_number", "rank", "prev", "row", "edge"), exp)


def test_equal_rows_and_empty_table(spark):
    copies = spark.range(3000).select(F.lit(1).alias("k"), F.lit(7).alias("v"))
    df = copies.unionByName(spark.range(2000).select((F.col("id") % 5).alias("k"), (F.col("id") % 11).alias("v")))
    got = over_buckets(df, ["k"], ["v"], F.col("v"))
    wr = Window.partitionBy("k").orderBy("v")
    _same(got.select("k", "v", "rank", "dense_rank"), df.select("k", "v", F.rank().over(wr), F.dense_rank().over(wr)))
    assert sorted(r[0] for r in got.where("k = 1").select("row_number").collect()) == list(range(1, 3401))
    assert over_buckets(df.limit(0), ["k"], ["v"], F.col("v"), lag={"p": "v"}).collect() == []


def test_a_hot_key_is_spread_over_its_buckets(spark):
    """A third of the rows have one key: no task holds them all, and the plan has
    neither Python nor a second shuffle of the rows."""
    df = spark.range(9000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 3000).alias("v"))
    got = over_buckets(df, ["k"], ["v"], F.floor(F.col("v") / 100), running={"s": "v"})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # the (key, bucket) window runs where the rows are: count the rows of the key in each task
        parts = got.where("k = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(parts) >= 5 and max(r["count"] for r in parts) <= 1500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan
    assert got.where("k = 1 AND v = 2999").first().s == sum(range(3000))


def _exact(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    lo, hi = values[int(h)], values[-int(-h // 1)]
    return lo + (h - int(h)) * (hi - lo)


@pytest.mark.parametrize("buckets", [4, 1024])
def test_percentiles_by_counting(spark, buckets):
    rnd = random.Random(buckets)
    groups = {None: [rnd.random() for _ in range(300)], 1: [float(rnd.randint(0, 5)) for _ in range(900)],  # hot, with ties
              2: [10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]) for _ in range(200)], 3: [4.0], 4: [1.0, 2.0],
              5: [1.7e308, -1.7e308, 0.0, 5e-324, -5e-324], 6: [float("inf"), float("-inf"), 1.0, 2.0, 3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(1, None), (7, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    ps = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {r.k: tuple(r)[1:] for r in exact_percentiles(df, ["k"], "v", ps, buckets).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for have, p in zip(got[g], ps):
            want = _exact(vs, p)
            assert have == want or have != have and want != want or abs(have - want) <= 1e-12 * abs(want)
    assert exact_percentiles(df.limit(0), ["k"], "v", ps).collect() == []


def test_rounds_shuffle_counts_only(spark):
    """What a round deals out is bounded by groups x buckets, not by the rows."""
    df = spark.range(50_000).select(F.lit(1).alias("key"), F.sqrt("id").alias("v"))
    counts = df.groupBy("key", bucket_of(F.col("v"), F.lit(0.0), F.sqrt(F.lit(49_999.0)), 64)).count()
    assert counts.count() <= 65 and counts.agg(F.sum("count")).first()[0] == 50_000
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Sort" not in plan
