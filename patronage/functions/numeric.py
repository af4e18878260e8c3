"""Column helpers for money, rounding, ratios and elapsed days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(20,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: str | Column) -> Column:
    """Exact sum of a money column as double: the result does not depend on the order of rows."""
    return F.sum(col(c).cast(MONEY)).cast("double")


def money_total(c: str | Column, window) -> Column:
    """``money_sum`` over a window."""
    return F.sum(col(c).cast(MONEY)).over(window).cast("double")


def exact_avg(c: str | Column, decimal: str = MONEY) -> Column:
    """Mean from an exact decimal sum; nulls are skipped."""
    c = col(c)
    return ratio(F.sum(c.cast(decimal)).cast("double"), F.count(c))


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale as double; null when the divisor is 0 or null."""
    quotient = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return quotient if scale == 1.0 else quotient * F.lit(scale)


def pct(num: Column, den: Column) -> Column:
    return ratio(num, den, 100.0)


def round_half_up(c: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals, halves upwards, and stay a double."""
    factor = F.lit(float(10**digits))
    return F.floor(c.cast("double") * factor + F.lit(0.5)) / factor


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour blocks from start to end (not calendar days)."""
    return F.timestamp_diff("DAY", start, end).cast("long")


def finite(c: str | Column) -> Column:
    """The value as double, with NaN, infinities and text that is not a number turned into null."""
    value = col(c).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def non_blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) != ""


def is_yes(c: str | Column) -> Column:
    """True for any spelling of 'yes'; null counts as no."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))) == "yes", F.lit(False))
