"""Interval overlaps and dominance counts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from erario.operators import intervals
from erario.operators.intervals import cover, earlier_higher, overlap_join
from erario.sources.logs import read_etl_records


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(250):  # lengths over three orders of magnitude, negative places, one hot key
        lo = rnd.randint(-3000, 3000)
        rows.append((i, rnd.choice([1, 1, 1, 2, None]), lo, lo + rnd.choice([0, 1, 7, 60, 2000, -1])))
    rows += [(300, 1, None, 5), (301, 1, 5, None), (302, 1, 4, 4), (302, 1, 4, 4)]
    df = spark.createDataFrame(rows, "id int, k int, lo int, hi int").repartition(4)
    got = overlap_join(df, df, ("lo", "hi"), ("lo", "hi"), [("k", "k")])
    pairs = sorted((r.left.id, r.right.id) for r in got.collect())
    sound = [r for r in rows if None not in r and r[2] <= r[3]]
    assert pairs == sorted((a[0], b[0]) for a in sound for b in sound if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlap_join(df.limit(0), df, ("lo", "hi"), ("lo", "hi")).collect() == []
    sound = [r for r in rows if None not in r[2:] and r[2] <= r[3]]  # without keys, NULL keys count too
    assert overlap_join(df, df, ("lo", "hi"), ("lo", "hi")).count() == sum(a[2] <= b[3] and b[2] <= a[3] for a in sound for b in sound)


def test_cells_cover_an_interval_exactly(spark):
    rnd = random.Random(4)
    spans = [(lo, lo + rnd.randint(0, 900)) for lo in (rnd.randint(-500, 500) for _ in range(60))]
    df = spark.createDataFrame(spans, "lo long, hi long")
    for r in df.select("lo", "hi", cover(F.col("lo"), F.col("hi"), 11).alias("cells")).collect():
        points = [p for c in r.cells for p in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(points) == list(range(r.lo, r.hi + 1)) and len(r.cells) <= 2 * 11


def test_dominance_against_all_pairs(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([1, 1, 2, 3, None]), rnd.choice([None, *range(40)]), rnd.choice([None, *range(-15, 15)])) for i in range(400)]
    rows += [(7, 1, 3, 3)] * 3
    df = spark.createDataFrame(rows, "id int, k int, day int, v int").withColumn("t", F.lit("clash"))
    got = earlier_higher(df, ["k"], "day", "v", F.floor(F.col("v") / 4))
    assert got.columns == [*df.columns, "earlier_higher"]

    def count(r):
        if r[2] is None or r[3] is None:
            return 0
        return sum(o[1] == r[1] and o[2] is not None and o[3] is not None and o[2] < r[2] and o[3] > r[3] for o in rows)

    assert sorted((r.id, r.earlier_higher) for r in got.collect()) == sorted((r[0], count(r)) for r in rows)
    assert earlier_higher(df.limit(0), ["k"], "day", "v", F.col("v")).collect() == []


def test_a_hot_customer_is_no_square(spark):
    """A third of all rows have one key: the counts come from n log n rows."""
    df = spark.range(6000).select((F.col("id") % 3 * F.col("id")).alias("k"), F.col("id").alias("day"), (-F.col("id")).alias("v"))
    got = earlier_higher(df, ["k"], "day", "v", F.floor(F.col("v") / 100))
    assert got.agg(F.max("earlier_higher")).first()[0] == 1999


def test_cells_of_a_small_table_are_not_broadcast(spark, tmp_root):
    """A table's file size tells nothing of the cells its rows are cut into."""
    spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("lo"), (F.col("id") + 9).alias("hi")).write.parquet(f"{tmp_root}/spans")
    df = spark.read.parquet(f"{tmp_root}/spans")
    got = overlap_join(df, df, ("lo", "hi"), ("lo", "hi"), [("k", "k")])
    assert got.count() == 500
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 40, 1000])
def test_dominance_is_the_same_by_arrays_and_by_digits(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    rnd = random.Random(9)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(-90, 90)]), float(rnd.randint(-15, 15))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, day int, v double")
    got = earlier_higher(df, ["k"], "day", "v", F.floor(F.col("v") / 4))
    known = [r for r in rows if r[2] is not None]
    assert {r.id: r.earlier_higher for r in got.collect()} == {
        r[0]: 0 if r[2] is None else sum(o[1] == r[1] and o[2] < r[2] and o[3] > r[3] for o in known) for r in rows}
    # rows are repeated for the digits of their times only in keys of many rows
    assert ("explode(sequence" in got._jdf.queryExecution().analyzed().toString()) == (few < 1000)


def test_log_records_across_splits(spark, tmp_root):
    head = "2024-01-0{} 10:00:00,123 - {} - message {}"
    first = ["lost line", head.format(1, "ERROR", 1), "Traceback:", "  File \"x\"", "ValueError: é", head.format(2, "INFO", 2)]
    second = [head.format(3, "ERROR", 3), *[f"  line {i}" for i in range(300)], head.format(4, "INFO", 4), ""]
    import os

    os.makedirs(f"{tmp_root}/log")
    for name, lines in (("a.log", first), ("b.log", second)):
        with open(f"{tmp_root}/log/{name}", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many splits a file
    try:
        rows = sorted(read_etl_records(spark, f"{tmp_root}/log").collect(), key=lambda r: (r.message is not None, r.message))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.level, r.message, r.n_lines) for r in rows] == [
        (None, None, 1), ("ERROR", "message 1", 4), ("INFO", "message 2", 1), ("ERROR", "message 3", 301), ("INFO", "message 4", 2)]
    assert rows[0].detail == "lost line" and rows[1].detail == "\n".join(first[2:5]) and rows[2].detail is None
    assert rows[3].detail == "\n".join(second[1:301]) and rows[4].detail == ""
