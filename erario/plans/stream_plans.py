"""Streaming queries over the test tables."""

from __future__ import annotations

from erario.plans.registry import register
from erario.streaming.events import run_window_counts


@register("stream_event_windows", "ST2 T13", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       COUNT(*) AS n_events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY 1, 2
""")
def stream_event_windows(spark, sf_dir):
    """Daily event counts per type from a watermarked file stream over the
    events table (append mode: finalised windows only; the open last day is
    not emitted)."""
    return run_window_counts(spark, sf_dir, "events.parquet", window="1 day", delay="1 hour")
