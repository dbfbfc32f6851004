"""Readers for the reference's log formats.

* Trace log: JSON lines written by the node decorator — timestamp, level,
  message, logger, trace_id, span_id, event_type, component, status,
  latency_ms, tokens{total_tokens, prompt_tokens, completion_tokens,
  total_cost}, input, output, error. Read with an explicit schema (no
  inference pass) in PERMISSIVE mode: a malformed line is kept in
  ``_corrupt_record`` instead of failing the job.
* ETL log: text lines ``asctime - LEVEL - message``; ``read_etl_records`` joins
  the lines of a traceback to their record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erario.operators.upsert import stage

TOKENS = T.StructType([
    T.StructField("total_tokens", T.LongType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_cost", T.DoubleType()),
])

TRACE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("tokens", TOKENS),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# The ETL log line format "asctime - levelname - message".
ETL_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - ([A-Z]+) - (.*)$"


def read_trace_log(spark: SparkSession, path: str) -> DataFrame:
    """Spans with a parsed ``ts`` (UTC) and a ``corrupt`` flag. Lines are read as
    text and parsed by a projection, so the flag alone can be counted."""
    spans = F.from_json("value", TRACE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return parse_trace(spark.read.text(path).where(F.trim("value") != "").select(spans.alias("s")).select("s.*"))


def parse_trace(df: DataFrame) -> DataFrame:
    return (df.withColumn("ts", F.try_to_timestamp(F.col("timestamp")))
            .withColumn("corrupt", F.col("_corrupt_record").isNotNull()))


def read_etl_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, message, line); lines that do not parse keep NULL fields
    (continuation lines of a traceback, for instance)."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_etl_lines(lines)


def read_etl_records(spark: SparkSession, path: str) -> DataFrame:
    """Whole log records: (ts, level, message, detail, n_lines, file). A record is
    a line of the log format, the head, and the lines up to the next head
    (``detail``, joined by line feeds; NULL if there are none). Lines of a file
    before its first head are one record without a head's fields.

    Lines are named by their place: file, split and position. The last head at
    or before a line is found in its split; where the split holds none, it is the
    last head of the splits before, a row each.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("split"),
                                       F.monotonically_increasing_id().alias("at"))
    lines = stage(raw.withColumn("starts", F.when(F.col("line").rlike(ETL_LINE), F.col("at"))), "etl-lines")
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = (lines.groupBy("file", "split").agg(F.max("starts").alias("last"))
               .select("file", "split", F.max("last").over(before).alias("carried")))
    placed = (lines.withColumn("own", F.max("starts").over(inside)).join(carried, ["file", "split"])
              .withColumn("head", F.coalesce("own", "carried")))
    records = placed.groupBy("file", "head").agg(
        F.max(F.when(F.col("starts") == F.col("at"), F.col("line"))).alias("line"), F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.when(F.col("starts").isNull(), F.struct("split", "at", "line")))).alias("rest"))
    detail = F.when(F.size("rest") > 0, F.array_join(F.col("rest.line"), "\n"))
    return (parse_etl_lines(records.select("*", detail.alias("detail")), keep=("detail", "n_lines", "file")).drop("line"))


def parse_etl_lines(lines: DataFrame, col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    ok = F.col(col).rlike(ETL_LINE)
    ts = F.concat(F.regexp_extract(col, ETL_LINE, 1), F.lit("."), F.regexp_extract(col, ETL_LINE, 2))
    return lines.select(
        F.when(ok, F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))).alias("ts"),
        F.when(ok, F.regexp_extract(col, ETL_LINE, 3)).alias("level"),
        F.when(ok, F.regexp_extract(col, ETL_LINE, 4)).alias("message"),
        F.col(col).alias("line"), *keep)
