"""CAL-1..6: calendar text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payload bytes of the first line and of continuation lines.
FIRST_BYTES, NEXT_BYTES = 75, 74


def calendar_stamp(iso: Column) -> Column:
    """CAL-1: local yyyyMMddTHHmmss of an ISO text; offset, Z and fraction go; empty and null give null."""
    bare = F.regexp_replace(F.nullif(iso, F.lit("")), r"([+-]\d{2}:?\d{2}|Z)$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[-:]", ""), r"\.\d+$", "")


def java_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash (factor 31) over UTF-16 units, as bigint."""
    return F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("bigint")


def uid(exam_id: Column, index: Column, domain: str) -> Column:
    """CAL-2: exam-{base 36 of the absolute hash}-{index}@{domain}; the absolute value is taken as bigint (-2^31)."""
    code = F.lower(F.conv(F.abs(java_hash(F.coalesce(exam_id, F.lit("")))).cast("string"), 10, 36))
    return F.concat(F.lit("exam-"), code, F.lit("-"), index.cast("string"), F.lit(f"@{domain}"))


def escape(text: Column) -> Column:
    """CAL-3: backslash first, then comma, semicolon and newline."""
    out = F.coalesce(text, F.lit(""))
    for raw, escaped in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def fold(line: Column) -> Column:
    """CAL-6: no line of more than 75 bytes of UTF-8; continuations start with a space and carry 74 bytes; no code
    point is split. Short lines, nearly all, skip the fold over characters."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"), F.lit(FIRST_BYTES).alias("room"))

    def step(a: Column, c: Column) -> Column:
        n = F.octet_length(c)
        full = a["size"] + n > a["room"]
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(full, c).otherwise(F.concat(a["cur"], c)).alias("cur"),
            F.when(full, n).otherwise(a["size"] + n).alias("size"),
            F.when(full, F.lit(NEXT_BYTES)).otherwise(a["room"]).alias("room"),
        )

    folded = F.aggregate(F.split(line, ""), zero, step, lambda a: F.array_join(F.concat(a["done"], F.array(a["cur"])), "\r\n "))
    return F.when(F.octet_length(line) <= FIRST_BYTES, line).otherwise(folded)


def description(code: Column, teacher: Column, class_name: Column, count: Column, notes: Column, footer: str) -> Column:
    """CAL-4: lines in this order, without empty ones."""
    # the labels are fixed values
    text = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    note = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("备注: "), notes))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("课程代码: "), text(code, "-")),
        F.concat(F.lit("教师: "), text(teacher, "未知")),
        F.concat(F.lit("班级: "), F.coalesce(class_name, F.lit(""))),
        F.concat(F.lit("人数: "), F.coalesce(count.cast("string"), F.lit("0"))),
        note,
        F.lit(footer),
    )


def place(campus: Column, location: Column) -> Column:
    """CAL-5: the campus in brackets only where there is one."""
    prefix = F.when(F.coalesce(campus, F.lit("")) != "", F.concat(F.lit("["), campus, F.lit("] "))).otherwise("")
    return F.concat(prefix, F.coalesce(location, F.lit("")))


def toggle(chosen: Column, item: Column) -> Column:
    """SET-4: symmetric difference of a set and a single value."""
    return F.when(F.array_contains(chosen, item), F.array_remove(chosen, item)).otherwise(F.concat(chosen, F.array(item)))


def elapsed(seconds: Column) -> Column:
    """Whole days, hours, minutes and seconds of a non-negative number of seconds; negative parts keep their sign."""
    s = seconds.cast("bigint")
    return F.struct(
        F.floor(s / 86400).cast("bigint").alias("days"),
        (F.floor(s / 3600).cast("bigint") % 24).alias("hours"),
        (F.floor(s / 60).cast("bigint") % 60).alias("minutes"),
        (s % 60).alias("seconds"),
    )
