"""CAL-7..10, JOIN-2, SNK-6, WIN-2: exams as the lines of calendar files, and those files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.ical import calendar_stamp, description, escape, fold, place, uid
from rostra.operators.ranking import numbered
from rostra.schema import DEFAULT_REMINDERS
from rostra.sources.files import OpenFile

_END = 2**31 - 1  # the event number of the closing line


def header_lines(calendar_name: Column, product: str) -> list[Column]:
    """CAL-7: the fixed head with the zone, which has no daylight saving. The calendar name isn't escaped."""
    # fixed values
    lines = [
        "BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "X-WR-CALNAME:", "CALSCALE:GREGORIAN", "METHOD:PUBLISH",
        "BEGIN:VTIMEZONE", "TZID:Asia/Shanghai", "X-LIC-LOCATION:Asia/Shanghai", "BEGIN:STANDARD", "TZOFFSETFROM:+0800",
        "TZOFFSETTO:+0800", "TZNAME:CST", "DTSTART:19700101T000000", "END:STANDARD", "END:VTIMEZONE",
    ]
    return [F.concat(F.lit(x), calendar_name) if x == "X-WR-CALNAME:" else F.lit(x) for x in lines]


def event_lines(numbered_exams: DataFrame, calendar: str, now: str, domain: str, footer: str, reminders: list[int] = DEFAULT_REMINDERS) -> DataFrame:
    """CAL-8: (calendar, event, line_no, line): folded lines of each numbered exam that has both stamps. `now` is the UTC stamp
    yyyyMMddTHHmmssZ."""
    whole = numbered_exams.filter("start_timestamp <> '' and end_timestamp <> ''")
    text = lambda prefix, value: F.concat(F.lit(prefix), escape(value))
    fixed = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), uid(F.col("id"), F.col("event"), domain)),
        F.lit(f"DTSTAMP:{now}"),
        F.concat(F.lit("DTSTART;TZID=Asia/Shanghai:"), calendar_stamp(F.col("start_timestamp"))),
        F.concat(F.lit("DTEND;TZID=Asia/Shanghai:"), calendar_stamp(F.col("end_timestamp"))),
        text("SUMMARY:", F.concat(F.lit("考试: "), F.coalesce("course_name", F.lit("")))),
        text("LOCATION:", place(F.col("campus"), F.col("location"))),
        text("DESCRIPTION:", description(F.col("course_code"), F.col("teacher"), F.col("class_name"), F.col("count"), F.col("notes"), footer)),
        F.lit("STATUS:CONFIRMED"),
    ]
    alarms = [
        line for m in reminders for line in ("BEGIN:VALARM", "ACTION:DISPLAY", "DESCRIPTION:Exam Reminder", f"TRIGGER:-PT{m}M", "END:VALARM")
    ]
    lines = F.array(*fixed, *map(F.lit, alarms), F.lit("END:VEVENT"))
    return whole.select(calendar, "event", F.posexplode(lines).alias("line_no", "line")).withColumn("line", fold(F.col("line")))


def calendar_lines(
    exams: DataFrame, calendar: str, now: str, domain: str = "example.org", product: str = "-//rostra//timetable//EN", footer: str = "Generated by rostra",
    reminders: list[int] = DEFAULT_REMINDERS, order: tuple[str, ...] = ("start_timestamp", "id"),
) -> DataFrame:
    """CAL-9: (calendar, event, line_no, line) of the files of all calendars at once; the column `calendar` says to which one an exam
    belongs (exams without any are left out). The head is event -1, the end comes last. Events count all exams of a
    calendar from 0 in `order`; exams without both stamps are skipped, and the number still advances. A calendar may hold
    any share of the exams: the numbers come from a range sort with carried state."""
    asc = [F.col(c).asc_nulls_last() for c in order]
    events = numbered(exams.filter(F.col(calendar).isNotNull()), [calendar], asc, "event", start=0)
    line = lambda event, no, text: F.struct(F.lit(event).cast("bigint").alias("event"), F.lit(no).alias("line_no"), text.alias("line"))
    frame = [line(-1, i, fold(c)) for i, c in enumerate(header_lines(F.col(calendar), product))]
    frame.append(line(_END, 0, F.lit("END:VCALENDAR")))
    frames = events.select(calendar).distinct().select(calendar, F.inline(F.array(*frame)))
    return frames.unionByName(event_lines(events, calendar, now, domain, footer, reminders))


def calendar_text(exams: DataFrame, calendar_name: str, now: str, **options) -> str:
    """CAL-9/10: the text of one selection, lines joined by CRLF and none at the end; an empty selection is an error."""
    named = exams.withColumn("_calendar", F.lit(calendar_name))
    lines = calendar_lines(named, "_calendar", now, **options).orderBy("event", "line_no").toLocalIterator()
    text = "\r\n".join(r.line for r in lines)
    if not text:
        raise ValueError("no exams to export")
    return text


def calendar_file(name: str | None) -> str:
    return "exams_" + re.sub(r'[\\/*?:"<>|]', "", name or "") + ".ics"


def write_calendars(exams: DataFrame, calendar: str, folder: str, now: str, **options) -> DataFrame:
    """SNK-6: one .ics file for each calendar, all of them in one job; (calendar, file, lines) of what was written. The folder is
    one that all executors share; a file appears when it is complete. The lines of a file are sorted by Spark and
    streamed to it, so a task holds no more than one batch of lines; a file has one writer. Runs when collected."""
    lines = calendar_lines(exams, calendar, now, **options).select(F.col(calendar).alias("calendar"), "event", "line_no", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, str, int]] = []
        name, out, n = None, None, 0
        for batch in batches:
            for calendar, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or calendar != name:
                    if out is not None:
                        out.close()
                        done.append((name, calendar_file(name), n))
                    name, out, n = calendar, OpenFile(folder, calendar_file(calendar)), 0
                out.write((("\r\n" if n else "") + line).encode("utf8"))
                n += 1
        if out is not None:
            out.close()
            done.append((name, calendar_file(name), n))
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["calendar", "file", "lines"])

    ordered = lines.repartition("calendar").sortWithinPartitions("calendar", "event", "line_no").select("calendar", "line")
    return ordered.mapInArrow(run, "calendar string, file string, lines bigint")


def reminders_of(exams: DataFrame, minutes: list[int]) -> DataFrame:
    """JOIN-2, SRT-6: (id, minutes, remind_s): one row for each exam and reminder; remind_s is in UTC seconds."""
    start = F.unix_micros(F.col("start_timestamp").try_cast("timestamp")) / 1_000_000
    each = F.explode(F.array_sort(F.array_distinct(F.array(*map(F.lit, minutes)))))
    return exams.filter("start_timestamp is not null").select("id", each.alias("minutes"), start.cast("bigint").alias("_s")).select(
        "id", "minutes", (F.col("_s") - F.col("minutes") * 60).alias("remind_s")
    )
