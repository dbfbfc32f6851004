"""Plan-shape guards: filters reach the scan, aggregations combine map-side,
no nested-loop or Cartesian joins, broadcasts only where bounded."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as E
from erario.operators.upsert import latest_per_key
from erario.plans import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compare_slices_pushes_filters_and_prunes(spark):
    df = E.queries()["compare_slices"](spark, SF_SMALL)
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "In(c_mktsegment" in p
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in p


def test_latest_per_key_combines_map_side(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.lit("x").alias("v"))
    assert "partial_max_by" in _plan(latest_per_key(df, ["k"], ["o"]))


@pytest.fixture()
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


BOUNDED_BROADCASTS = {"join_region_revenue", "decode_codes"}  # nation (25) / region (5)


registry.load_all()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n != "stream_event_windows" and not n.startswith("load_")))
def test_no_nested_loop_or_cartesian(spark, no_auto_broadcast, name):
    df = E.queries()[name](spark, SF_SMALL)
    p = _plan(df)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    if "BroadcastExchange" in p and name not in BOUNDED_BROADCASTS:
        raise AssertionError(f"{name} broadcasts")
