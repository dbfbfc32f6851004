"""Defensive decoding of tool results.

The reference's generated code received query results that were sometimes a
list of dicts, sometimes JSON strings, and decoded them defensively: a JSON
list gives many rows, an object or scalar gives one, text that is not JSON is
kept as raw text (or skipped), and a missing field reads as 0. Here that is a
column job over a text column of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.functions.jsontext import root_kind


def decode_rows(df: DataFrame, col: str, fields: dict[str, object], keep_raw: bool = True) -> DataFrame:
    """One row per decoded record with ``fields`` (missing -> default),
    ``pos`` (position in a list, NULL otherwise) and ``raw`` (the text of a
    record that is not JSON; NULL for decoded ones). ``keep_raw=False`` drops
    undecodable records instead."""
    kind = root_kind(F.col(col))
    items = (F.when(kind == "array", F.from_json(F.col(col), "array<string>"))
             .when(kind.isin("object", "scalar"), F.array(F.col(col)))
             .otherwise(F.array(F.col(col))))
    base = [c for c in df.columns if c != col]
    ex = df.select(*base, kind.alias("_kind"), F.posexplode(items).alias("pos", "_item"))
    ex = ex.withColumn("pos", F.when(F.col("_kind") == "array", F.col("pos")))
    ok = F.col("_kind") != "invalid"
    if not keep_raw:
        ex = ex.filter(ok)
    out = [*[F.col(c) for c in base], "pos"]
    for name, default in fields.items():
        v = F.get_json_object(F.col("_item"), f"$.{name}")
        out.append(F.when(ok, F.coalesce(v, F.lit(str(default)))).alias(name))
    out.append(F.when(~ok, F.col("_item")).alias("raw"))
    return ex.select(*out)
