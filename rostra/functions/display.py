"""PRJ-13 and the display date: what a card shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for missing fields.
CARD_DEFAULTS = {"course_code": "No Code", "location": "地点待定", "teacher": "未知", "raw_time": "未发布"}
_WEEKDAYS = "日一二三四五六"


def card_field(name: str) -> Column:
    """Empty and null count as missing; a head count only if it is null."""
    if name == "count":
        return F.coalesce(F.col("count").cast("string"), F.lit("-"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(CARD_DEFAULTS[name]))


def display_date(stamp: Column) -> Column:
    """Month, day, weekday and time in Chinese, at +08:00 whatever the offset of the stamp; empty for a missing one."""
    wall = F.floor(F.unix_micros(stamp.try_cast("timestamp")) / 1_000_000).cast("bigint") + 8 * 3600
    day, rest = F.floor(wall / 86400).cast("int"), F.pmod(wall, F.lit(86400))
    date = F.date_from_unix_date(day)
    weekday = F.substring(F.lit(_WEEKDAYS), F.dayofweek(date), F.lit(1))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    text = F.concat(F.month(date).cast("string"), F.lit("月"), F.dayofmonth(date).cast("string"), F.lit("日周"), weekday, F.lit(" "), two(rest / 3600), F.lit(":"), two(rest / 60 % 60))
    return F.coalesce(text, F.lit(""))


def display(c: Column, cut: int, bars: bool = False) -> Column:
    """PRJ-11/12: cut, newlines as spaces, bars as slashes."""
    text = F.translate(F.left(c, F.lit(cut)), "\n", " ")
    return F.translate(text, "|", "/") if bars else text
