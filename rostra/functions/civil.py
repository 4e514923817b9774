"""Calendar arithmetic on integers, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, n: int) -> Column:
    """Whole quotient, rounded down, on integers alone."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when((m == 4) | (m == 6) | (m == 9) | (m == 11), 30).otherwise(31)  # in lambdas cheaper than isin


def valid_date(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce((y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= days_in_month(y, m)), F.lit(False))


def days_from_date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a valid proleptic Gregorian date: years start in March, so that the leap
    day comes last and month lengths follow (153 m + 2) / 5."""
    y, m, d = y.cast("bigint"), m.cast("bigint"), d.cast("bigint")
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = F.pmod(m + 9, F.lit(12))
    return yy * 365 + floor_div(yy, 4) - floor_div(yy, 100) + floor_div(yy, 400) + floor_div(mm * 153 + 2, 5) + d - 719469


def clock_text(seconds: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss of seconds since the epoch, as they stand."""
    day, rest = floor_div(seconds, 86400), F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    date = F.date_from_unix_date(day.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), two(floor_div(rest, 3600)), F.lit(":"), two(floor_div(rest, 60) % 60), F.lit(":"), two(rest % 60))
