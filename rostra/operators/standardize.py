"""PRJ-1..9, SET-1: heterogeneous sheets become standard records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import clean_text, coerce_count, coerce_number
from rostra.functions.timeparse import beijing_text, parse_time_range
from rostra.operators.ranking import numbered
from rostra.schema import ALIASES, RECORD_FIELDS, TEXT_FIELDS
from rostra.session import broadcast_if_small


def resolve_aliases(columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str | None]:
    """PRJ-1, JOIN-3: of each standard field the first alias among the columns, exactly as written, else None."""
    present = set(columns)
    return {field: next((a for a in names if a in present), None) for field, names in aliases.items()}


def rename_to_standard(sheet: DataFrame, keep: list[str]) -> DataFrame:
    """PRJ-2: the standard fields under their names, null where the sheet has none; `keep` columns stay. Extra columns
    are left behind, so that only the mapped ones are read from the file."""
    found = resolve_aliases(sheet.columns)
    return sheet.select(
        *[F.col(f"`{k}`") for k in keep],
        *[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f) for f, c in found.items()],
    )


def resolve_by_join(columns: DataFrame, alias: DataFrame, keys: list[str], fields: list[str] = list(ALIASES)) -> DataFrame:
    """JOIN-3 for many sheets at once: (keys, field, column, mapped) of sheets' columns (keys, column) and aliases
    (field, alias_pos, alias): of each of the fields the first alias present. Fields without any have a null column."""
    every = columns.select(*keys).distinct().withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    hits = columns.join(broadcast_if_small(alias), F.col("column") == F.col("alias")).groupBy(*keys, "field").agg(F.min_by("column", "alias_pos").alias("column"))
    return every.join(hits, [*keys, "field"], "left").withColumn("mapped", F.col("column").isNotNull())


def column_mapping(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ-18: (keys, column_mapping): of each sheet the map of its resolved fields to their columns; empty if there is none."""
    pair = F.when(F.col("mapped"), F.struct("field", "column"))
    return resolved.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("column_mapping"))


def number_rows(df: DataFrame, file: str, order: list[str]) -> DataFrame:
    """PRJ-3/4: row numbers per file from 2 on (the header is row 1) and the id "{file}-{row}", for sheets whose reader gave no
    row number."""
    return numbered(df, [file], order, "row_no", start=2).withColumn("row_id", F.concat(F.col(file), F.lit("-"), F.col("row_no")))


def count_value(df: DataFrame, column: str) -> Column:
    """PRJ-7 by the type of the cell. Values over 32 bits are kept as 64 bits, beyond that they are 0."""
    kind = df.schema[column].dataType.typeName()
    return coerce_count(F.col(column)) if kind == "string" else coerce_number(F.col(column))


def to_records(df: DataFrame) -> DataFrame:
    """Cleaned and parsed records from standard columns; all other columns stay in front. A row that can't be parsed
    is kept: null stamps and the error class in parse_error."""
    rest = [c for c in df.columns if c not in RECORD_FIELDS or c == "id"]
    clean = df.withColumns({f: clean_text(F.col(f)) for f in TEXT_FIELDS} | {"count": count_value(df, "count")})
    # the parsed parts are taken in one projection above the parse, which is evaluated once
    parsed = clean.withColumn("_t", parse_time_range(F.col("raw_time")))
    return parsed.select(
        *rest, *TEXT_FIELDS[:7], "count", *TEXT_FIELDS[7:],
        beijing_text(F.col("_t.start_s")).alias("start_timestamp"), beijing_text(F.col("_t.end_s")).alias("end_timestamp"),
        F.coalesce("_t.minutes", F.lit(0)).alias("duration_minutes"), F.col("_t.date").alias("date"), F.col("_t.error").alias("parse_error"),
    )


def standardize(sheets: list[DataFrame], keep: list[str]) -> DataFrame:
    """SET-1: every sheet by its own headers, all of them one under the other (repeats across files stay)."""
    if not sheets:
        raise ValueError("no sheets to standardize")
    return to_records(reduce(DataFrame.unionByName, [rename_to_standard(s, keep) for s in sheets]))
