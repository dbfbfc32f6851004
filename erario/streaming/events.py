"""Tumbling-window event counts as a Structured Streaming job (ST2).

Events (or trace spans) are read as a file stream, stamped with a watermark
and counted per fixed window in *append* mode: a window is written once, when
the watermark (latest event time seen minus ``delay``) passes its end, and
its state is then dropped — the state holds only the open windows, however
long the stream runs. The still-open last window is not emitted, by design.

``timestamp_ntz`` columns are cast to ``timestamp`` first (a watermark needs
a time-zone-aware event time; the session time zone is UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.session import scratch_dir


def window_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                  window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The streaming aggregation (works on a batch DataFrame too)."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        s = s.withWatermark(ts, delay)
    agg = s.groupBy(F.window(ts, window).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col(value).cast("decimal(18,2)")).alias("_total"))
    return agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), key, "n_events",
                      F.col("_total").cast("double").alias("total_value"))


def run_window_counts(spark: SparkSession, source_dir: str, file_glob: str, window: str = "1 day",
                      delay: str = "1 hour", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over the files available now (``availableNow``, in one
    micro-batch, so that no file is late because another was read first), write
    the finalised windows to a Parquet sink under the shared checkpoint folder
    and return them as a batch DataFrame."""
    schema = spark.read.parquet(f"{source_dir.rstrip('/')}/{file_glob}").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .parquet(source_dir))
    out = window_counts(stream, window=window, delay=delay)
    sink = sink or scratch_dir(spark, "event-windows")
    checkpoint = checkpoint or scratch_dir(spark, "event-windows-ckpt")
    q = (out.writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def late_counts(events: DataFrame, emitted: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                window: str = "1 day") -> DataFrame:
    """What came too late for its window: per window and key the events (and
    their total) that ``events``, all that were read, hold beyond ``emitted``,
    the stream's result so far. Windows after the last emitted one are open and
    not counted; a window that lost nothing has no row.

    The stream drops late rows without a trace (its metric counts partial
    aggregates, not events), so they are found by counting the events again."""
    last = emitted.agg(F.max("window_start")).first()[0]
    every = window_counts(events, ts, key, value, window).where(F.col("window_start") <= F.lit(last))
    known = emitted.select("window_start", F.col(key).alias("k"), F.col("n_events").alias("n"), F.col("total_value").alias("t"))
    known = known.withColumnRenamed("window_start", "w")
    late = every.join(known, (F.col("window_start") == F.col("w")) & F.col(key).eqNullSafe(F.col("k")), "left")
    money = lambda c: F.coalesce(F.col(c).cast("decimal(18,2)"), F.lit(0))
    return (late.select("window_start", key, (F.col("n_events") - F.coalesce("n", F.lit(0))).alias("n_late"),
                        (money("total_value") - money("t")).cast("double").alias("total_late"))
            .where("n_late > 0"))
