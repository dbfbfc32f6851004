"""Audit query library: the query shapes the reference's prompts ask for.

Every function is ``DataFrame -> DataFrame`` and parameterised by column names,
so the same job runs on the silver audit tables (despesas, receitas,
licitacoes) and on any table of that shape. Aggregations are plain
``groupBy().agg()``: Spark combines partially on the map side, so a hot key
costs one row per task in the shuffle, never the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.functions.money import money, money_sum, ratio


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_range(date_col: str, first_year: int, last_year: int) -> Column:
    """``first_year <= year(date) <= last_year`` written as a range on the raw
    column, so it is pushed down to the Parquet scan (a filter on
    ``year(date)`` is not)."""
    c = F.col(date_col)
    return (c >= F.lit(f"{first_year:04d}-01-01").cast("timestamp_ntz")) & \
        (c < F.lit(f"{last_year + 1:04d}-01-01").cast("timestamp_ntz"))


def filter_limit(df: DataFrame, cond: Column, columns: Sequence[str],
                 order: Sequence[Column], limit: int = 5) -> DataFrame:
    """Filter, project named columns, order, and keep ``limit`` rows
    (default 5, the reference's default answer size). Ordering makes the limit
    deterministic; Spark plans it as a per-task top-k (TakeOrderedAndProject)."""
    return df.filter(cond).select(*columns).orderBy(*order).limit(limit)


def filtered_total(df: DataFrame, cond: Column, value: str,
                   alias: str = "total", count_alias: str = "n_rows") -> DataFrame:
    """One filtered global SUM (money) and COUNT."""
    return df.filter(cond).agg(money_sum(value).alias(alias),
                               F.count(F.lit(1)).alias(count_alias))


def compare_slices(df: DataFrame, value: str, slice_col: str, a: str, b: str,
                   names: tuple[str, str, str] = ("total_a", "total_b", "difference")
                   ) -> DataFrame:
    """C17: two filtered totals and their difference in one pass.

    Equivalent to two ``SUM`` queries and a subtraction, but the table is read
    once: ``sum(CASE WHEN slice = a ...)`` and ``sum(CASE WHEN slice = b ...)``.
    An empty slice totals 0.
    """
    s = F.col(slice_col)
    v = F.col(value).cast("decimal(38,2)")  # money, or already-summed money
    ta = F.coalesce(F.sum(F.when(s == F.lit(a), v)), F.lit(0).cast("decimal(38,2)"))
    tb = F.coalesce(F.sum(F.when(s == F.lit(b), v)), F.lit(0).cast("decimal(38,2)"))
    return (df.filter(s.isin(a, b))
            .agg(ta.alias("_a"), tb.alias("_b"))
            .select(F.col("_a").cast("double").alias(names[0]),
                    F.col("_b").cast("double").alias(names[1]),
                    (F.col("_a") - F.col("_b")).cast("double").alias(names[2])))


def exclude_status(df: DataFrame, status_col: str, excluded: Sequence[str],
                   keep_null: bool = True) -> DataFrame:
    """Leave out cancelled/failed rows. ``NOT IN`` alone would also drop
    rows whose status is NULL; the NULL rule is explicit here."""
    s = F.col(status_col)
    cond = ~s.isin(*excluded)
    if keep_null:
        cond = s.isNull() | cond
    return df.filter(cond)


def retention_window(df: DataFrame, date_col: str, current_year: int,
                     years: int = 5) -> DataFrame:
    """Keep the last ``years`` fiscal years up to ``current_year``.
    Written as a range on the date column (pushed down / partition pruned)."""
    return df.filter(year_range(date_col, current_year - years + 1, current_year))


def evolution(df: DataFrame, date_col: str, years: Sequence[int],
              count_alias: str = "n", year_alias: str = "year") -> DataFrame:
    """Count per year for the listed years, combined and grouped."""
    ys = sorted(years)
    return (df.filter(year_range(date_col, ys[0], ys[-1]))
            .withColumn(year_alias, F.date_format(date_col, "yyyy"))
            .filter(F.col(year_alias).isin(*[str(y) for y in ys]))
            .groupBy(year_alias).agg(F.count(F.lit(1)).alias(count_alias)))


def year_over_year(df: DataFrame, date_col: str, value: str,
                   keys: Sequence[str] = (), year_alias: str = "year") -> DataFrame:
    """Total per year and the absolute change from the previous year.

    The table is aggregated to one row per (keys, year) first; the ``lag``
    window then runs over that small result, whose size is bounded by the
    number of years times the number of key values, never by the raw rows.
    """
    agg = (df.withColumn(year_alias, F.date_format(date_col, "yyyy"))
           .groupBy(*keys, year_alias).agg(F.sum(money(value)).alias("_t")))
    w = Window.partitionBy(*keys).orderBy(year_alias)
    prev = F.lag("_t").over(w)
    return agg.select(*keys, year_alias,
                      F.col("_t").cast("double").alias("total"),
                      prev.cast("double").alias("previous_total"),
                      (F.col("_t") - prev).cast("double").alias("change"))


def budget_execution(df: DataFrame, stages: Sequence[tuple[str, Column]],
                     keys: Sequence[str] = ()) -> DataFrame:
    """C20: money through successive stages and the ratio of each stage to the
    first (committed -> verified -> paid; collected vs budgeted).

    ``stages`` is an ordered list of (name, column name or decimal
    expression); a column name is read as money, an expression is summed
    exactly as given (build it from ``money()`` terms so products stay exact).
    Ratios use ``try_divide`` (NULL on a zero first stage, like SQLite's x/0).
    """
    aggs = [F.sum(money(expr) if isinstance(expr, str) else expr).alias(f"_{name}")
            for name, expr in stages]
    out = df.groupBy(*keys).agg(*aggs)
    first = stages[0][0]
    cols = [F.col(k) for k in keys]
    for name, _ in stages:
        cols.append(F.col(f"_{name}").cast("double").alias(name))
    for name, _ in stages[1:]:
        cols.append(ratio(F.col(f"_{name}"), F.col(f"_{first}")).alias(f"{name}_ratio"))
    return out.select(*cols)


def top_recipients(df: DataFrame, key: str, value: Column | str, k: int = 5,
                   total_alias: str = "total") -> DataFrame:
    """Group, order by total descending (ties by key), keep ``k``.

    Partial aggregation makes the shuffle one row per (task, key); the final
    ordering is a per-task top-k merged on the driver (TakeOrderedAndProject),
    so only ``k`` rows per task move. A column name is read as money, an
    expression is summed and ranked exactly as given.
    """
    v = money(value) if isinstance(value, str) else value
    return (df.groupBy(key).agg(F.sum(v).alias("_total"))
            .orderBy(F.col("_total").desc(), F.col(key).asc()).limit(k)
            .select(key, F.col("_total").cast("double").alias(total_alias)))


def group_having(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                 having: Column) -> DataFrame:
    """GROUP BY + HAVING."""
    return df.groupBy(*keys).agg(*aggs).filter(having)
