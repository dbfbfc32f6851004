"""erario: municipal-finance audit analytics on Spark.

Layout
------
functions/  Column -> Column helpers (text, dates, keys, money)
operators/  DataFrame -> DataFrame jobs (ingest, upsert, ledger, catalog,
            audit queries, windows by order buckets, text governance, traces)
sources/    readers for landed payloads, logs and the test tables
plans/      the registered query library (Spark plan + DuckDB oracle SQL)
streaming/  Structured Streaming versions of the ingest and event jobs
"""

from erario.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
