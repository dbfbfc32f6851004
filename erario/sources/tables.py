"""Readers for the driver's test tables (one Parquet file per table).

Readers are lazy: column pruning and filter push-down reach the Parquet scan
through Catalyst, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Tables whose size is fixed by the domain, not by the scale factor
# (TPC-H style: 5 regions, 25 nations). Only these are broadcast by name.
BOUNDED_DIMENSIONS = {"region": 5, "nation": 25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the test tables as temporary views under their own names."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
