"""Month and fiscal-period strings.

The reference names months as ``YYYYMM`` text, passes the fiscal year as
``YYYY00`` and asks for tenders by a ``first-day_last-day`` date range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_ref(d) -> Column:
    """``YYYYMM`` of a date or timestamp."""
    return F.date_format(_c(d), "yyyyMM")


def year_text(d) -> Column:
    """Four-digit year of a date or timestamp, as text (years are TEXT)."""
    return F.date_format(_c(d), "yyyy")


def fiscal_year_param(year) -> Column:
    """``YYYY00``: the fiscal-year parameter of the finance feeds."""
    return F.concat(F.lpad(_c(year).cast("string"), 4, "0"), F.lit("00"))


def month_start(year, month) -> Column:
    return F.make_date(_c(year).cast("int"), _c(month).cast("int"), F.lit(1))


def month_bounds(year, month) -> Column:
    """struct(first_day, last_day, start_end) for a (year, month) pair.

    ``start_end`` is ``YYYY-MM-01_YYYY-MM-<last>``; ``last_day`` is leap-safe.
    """
    first = month_start(year, month)
    last = F.last_day(first)
    start_end = F.concat_ws("_", F.date_format(first, "yyyy-MM-dd"),
                            F.date_format(last, "yyyy-MM-dd"))
    return F.struct(first.alias("first_day"), last.alias("last_day"),
                    start_end.alias("start_end"))


def normalize_month_ref(mes, year) -> Column:
    """Accept ``YYYYMM`` or ``MM`` (plus the fiscal year) and return ``YYYYMM``.

    Anything else becomes NULL so that it can be counted rather than guessed.
    """
    m = F.trim(_c(mes).cast("string"))
    y = F.trim(_c(year).cast("string"))
    mm_ok = m.rlike("^(0[1-9]|1[0-2])$")
    yyyymm_ok = m.rlike("^[0-9]{4}(0[1-9]|1[0-2])$")
    single = m.rlike("^[1-9]$")
    return (F.when(yyyymm_ok, m)
            .when(mm_ok & y.rlike("^[0-9]{4}$"), F.concat(y, m))
            .when(single & y.rlike("^[0-9]{4}$"), F.concat(y, F.lit("0"), m)))


def julian_day(ts) -> Column:
    """Days since noon of 24 November 4714 BC (proleptic Gregorian) as a double,
    what SQL's ``julianday`` gives: 2440587.5 at the start of 1970, UTC."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(2440587.5)


def shift_months(d, n) -> Column:
    """The date ``n`` months on. A day that the month does not have runs on into
    the next (31 January and a month: 2 or 3 March), as ``date(d, '+n month')``
    does; ``add_months`` would give the month's last day."""
    day = _c(d).cast("date")
    return F.date_add(F.add_months(F.trunc(day, "month"), n), F.dayofmonth(day) - 1)


def months_apart(later, earlier) -> Column:
    """Calendar months from one date's month to another's, days aside."""
    a, b = _c(later).cast("date"), _c(earlier).cast("date")
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
