"""Money arithmetic.

Silver tables keep money as double (the reference's REAL affinity). Sums are
taken over ``decimal(18,2)`` so totals are exact and do not depend on the order
in which partitions are combined; the result is cast back to double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Cast a money value to ``decimal(18,2)``."""
    return _c(c).cast(MONEY)


def money_sum(c) -> Column:
    """Exact, order-independent sum of a money column, as double."""
    return F.sum(money(c)).cast("double")


def money_sum_if(cond: Column, c) -> Column:
    """``SUM(CASE WHEN cond THEN v END)`` over money, as double."""
    return F.sum(F.when(cond, money(c))).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of failing on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))
