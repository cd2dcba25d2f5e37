"""Column expressions shared by the marts. All are built-in Spark expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL = "decimal(38,4)"
AMOUNT = "decimal(18,4)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stamp(moment: datetime) -> Column:
    """A wall-clock literal (no time zone)."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def midnight(moment: datetime, days_back: int = 0) -> datetime:
    """Start of the day ``days_back`` days before ``moment``."""
    day = moment.replace(hour=0, minute=0, second=0, microsecond=0)
    return day - timedelta(days=days_back)


def in_window(col, as_of: datetime, days: int) -> Column:
    """``date(col) >= date(as_of) - days``, written on the bare column so that
    file statistics and partition values can prune."""
    return _c(col) >= stamp(midnight(as_of, days))


def normalize_code(col) -> Column:
    """Upper case, no blanks at the ends; nothing else is touched."""
    return F.upper(F.trim(_c(col)))


def is_blank(col) -> Column:
    return _c(col).isNull() | (F.trim(_c(col)) == "")


def valid_at(start, end, moment: datetime) -> Column:
    """Started by ``moment`` and not ended; an open end is valid for ever."""
    at = stamp(moment)
    return (_c(start) <= at) & (_c(end).isNull() | (_c(end) >= at))


def out_of_range(col, low: float, high: float) -> Column:
    c = _c(col)
    return F.isnan(c) | ~c.between(low, high)


def money(col, total: bool = True) -> Column:
    return _c(col).cast(TOTAL if total else AMOUNT)


def sum_if(condition: Column, col) -> Column:
    """Conditional sum; a sum over nothing is zero, not null."""
    return F.coalesce(F.sum(F.when(condition, _c(col))), F.lit(0))


def money_sum(col) -> Column:
    return F.coalesce(F.sum(_c(col)), F.lit(0)).cast(TOTAL)


def money_if(condition: Column, col) -> Column:
    return sum_if(condition, col).cast(TOTAL)


def ratio(num, den) -> Column:
    """``num / den`` as double; zero where the denominator is zero."""
    num, den = _c(num).cast("double"), _c(den).cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def average_money(total, count) -> Column:
    """Money per unit at four decimals, half up; zero where there is nothing.

    The operands are narrowed before the division so that the quotient keeps
    14 decimals and is rounded once.
    """
    total, count = _c(total).cast("decimal(28,4)"), _c(count).cast("decimal(12,0)")
    return (
        F.when(count == 0, F.lit(0).cast(TOTAL))
        .otherwise((total / count).cast(TOTAL))
        .cast(TOTAL)
    )


def quotient(num, den, scale: int) -> Column:
    """Decimal quotient at a fixed scale, half up. The caller guards zero."""
    num, den = _c(num).cast(AMOUNT), _c(den).cast(AMOUNT)
    return (num / F.nullif(den, F.lit(0).cast(AMOUNT))).cast(f"decimal(38,{scale})")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def seconds_between(start, end) -> Column:
    """Number of whole-second boundaries from ``start`` to ``end``."""
    epoch = stamp(datetime(1970, 1, 1))
    return F.timestamp_diff("SECOND", epoch, _c(end)) - F.timestamp_diff(
        "SECOND", epoch, _c(start)
    )


def age_seconds(col, as_of: datetime) -> Column:
    return seconds_between(_c(col), stamp(as_of))


def days_between(start, end) -> Column:
    """Number of midnights from ``start`` to ``end`` (not elapsed 24 h)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def months_between_calendar(start, end) -> Column:
    start, end = _c(start), _c(end)
    return 12 * (F.year(end) - F.year(start)) + F.month(end) - F.month(start)


def month_of(col) -> Column:
    return F.trunc(F.to_date(_c(col)), "MM")
