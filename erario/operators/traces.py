"""Trace analytics: span statistics and per-trace rollups.

The reference only emits spans (one JSON line per decorated node call); these
jobs read them back. Both are aggregations (map-side combined); latency
percentiles are exact and skew-safe (``stats.exact_percentiles``).

Caveat kept from the reference: ``trace_id`` is not part of the agent state,
so every span gets a fresh id and a "trace" is usually one span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.operators.stats import exact_percentiles
from erario.operators.windows import null_safe_join


def span_stats(spans: DataFrame, by: Sequence[str] = ("component", "event_type"),
               ps: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per component and event type: calls, errors, error rate, mean and
    percentile latency, tokens and cost. Corrupt lines are left out."""
    s = spans.filter(~F.col("corrupt")) if "corrupt" in spans.columns else spans
    by = list(by)
    err = F.col("status") == "ERROR"
    agg = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(err, 1)).alias("errors"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("tokens.total_tokens").alias("total_tokens"),
        F.sum("tokens.prompt_tokens").alias("prompt_tokens"),
        F.sum("tokens.completion_tokens").alias("completion_tokens"),
        F.sum("tokens.total_cost").alias("total_cost"))
    agg = agg.withColumn("error_rate", F.col("errors") / F.col("calls"))
    pct = exact_percentiles(s.filter(F.col("latency_ms").isNotNull()), by, "latency_ms", ps)
    return null_safe_join(agg, pct, by, "left")


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Per trace: spans, first/last timestamp, summed latency, tokens and
    cost, whether any span failed, and the (bounded) set of components."""
    s = spans.filter(~F.col("corrupt")) if "corrupt" in spans.columns else spans
    return s.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.sum("latency_ms").alias("latency_ms"),
        F.sum("tokens.total_tokens").alias("total_tokens"),
        F.sum("tokens.total_cost").alias("total_cost"),
        F.max((F.col("status") == "ERROR").cast("int")).cast("boolean").alias("failed"),
        # the component domain is the fixed set of graph nodes
        F.array_sort(F.collect_set("component")).alias("components"))
