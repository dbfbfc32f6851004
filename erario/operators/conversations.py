"""Conversation transcripts: last turns and ordered message lists.

A transcript is the table ``(conv_id, turn, role, text)``. The reference looks
for "the last user message" (optionally skipping context messages) in an
in-memory list; here that is a ``max_by`` aggregation per conversation, which
combines on the map side, so a very long conversation is never collected into
one task. The ordered list itself is produced as rows by windows over order buckets
(``plans.window_plans.transcript``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_turn(messages: DataFrame, role: str | None = None, exclude_roles: Sequence[str] = (),
              exclude_prefixes: Sequence[str] = (), key: str = "conv_id", turn: str = "turn",
              text: str = "text") -> DataFrame:
    """Latest message per conversation among those of ``role`` (any role when
    None), leaving out ``exclude_roles`` and texts starting with one of
    ``exclude_prefixes`` (context markers)."""
    m = messages
    if role is not None:
        m = m.filter(F.col("role") == role)
    if exclude_roles:
        m = m.filter(~F.col("role").isin(*exclude_roles))
    for p in exclude_prefixes:
        m = m.filter(~F.startswith(F.col(text), F.lit(p)))
    return m.groupBy(key).agg(F.max(turn).alias(turn), F.max_by(text, turn).alias(text))
