"""AGG-1..21, LIM-1/2: column profiles, per-file statistics and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions.display import display
from rostra.functions.text import blank_to_null
from rostra.operators.ranking import numbered
from rostra.schema import MAX_ERRORS, MAX_SAMPLES
from rostra.session import checkpointed

#: AGG-5: names of Spark types as the profile reports them.
_TYPE_NAMES = {"string": "object", "int": "int64", "bigint": "int64", "double": "float64", "boolean": "bool"}


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """AGG-2: half-even on decimals; 0 where there is nothing to divide."""
    exact = (part.cast("decimal(18,0)") * 100 / F.greatest(whole, F.lit(1)).cast("decimal(18,0)")).cast("decimal(20,8)")
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(exact, digits).cast("double"))


def unpivot(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, column, value): one row per cell, all values as text."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(*keys, F.inline(F.array(*cells)))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-1..3, 5: per column its type, non-null and null counts, non-null percent and distinct count.

    One pass and one shuffle whatever the number of columns: cells are counted by (column, value) with map-side
    combine, then summed per column, instead of a count(distinct) per column, which would copy each row as
    often as there are columns. No rows for an empty table's columns are lost: they come out with zeros.
    """
    kinds = [(c, _TYPE_NAMES.get(t, t)) for c, t in df.select(*[f"`{c}`" for c in columns]).dtypes]
    values = unpivot(df, columns, []).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = values.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.sum("n").alias("total"),
        F.count("value").alias("n_distinct"),
    )
    names = df.sparkSession.createDataFrame(kinds, "column string, kind string")
    out = names.join(sums, "column", "left").fillna(0, ["non_null", "total", "n_distinct"])
    return out.select(
        "column", "kind", "non_null", (F.col("total") - F.col("non_null")).alias("nulls"),
        percent(F.col("non_null"), F.col("total")).alias("non_null_pct"), "n_distinct",
    )


def first_values(df: DataFrame, columns: list[str], order: list[Column], top: int = MAX_SAMPLES) -> DataFrame:
    """AGG-4, WIN-3: (column, samples): the first `top` distinct values of each column in order of appearance, each cut
    to 30 characters. Values collapse to their first position map-side; then each partition keeps only its own first
    ones before they meet, so no task sees all values of a column."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    cells = unpivot(df.select(*[f"`{c}`" for c in columns], place.alias("_at")), columns, ["_at"]).filter("value is not null")
    firsts = cells.groupBy("column", "value").agg(F.min("_at").alias("_at"))
    # a salted first cut: the winners of every salt contain the overall winners
    salted = firsts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_at", "value"))
    kept = salted.withColumn("_r", rank("column", "_salt")).filter(F.col("_r") <= top)
    kept = kept.withColumn("_r", rank("column")).filter(F.col("_r") <= top)
    pair = F.array_sort(F.collect_list(F.struct("_r", F.left("value", F.lit(30)).alias("v"))))
    return kept.groupBy("column").agg(F.array_join(F.transform(pair, lambda x: x["v"]), ", ").alias("samples"))


def _dtype(kinds: Column, nulls: Column, rows: Column) -> Column:
    """AGG-5: the type that a column of cells of these kinds gets: whole numbers with gaps are floats, an empty column of some rows
    is one of floats, everything mixed is object."""
    only = lambda *names: F.forall(kinds, lambda k: k.isin(*names))
    return (
        F.when(rows == 0, "object").when(only("int") & (nulls == 0), "int64").when(only("int", "float"), "float64").when(only("bool") & (nulls == 0), "bool")
        .when(only("date"), "datetime64[ns]").otherwise("object")
    )


def sheet_profile(sheets: DataFrame, file: str, row: str, cells: str = "cells", top: int = MAX_SAMPLES) -> DataFrame:
    """AGG-1..5 for all files at once: (file, column, place, kind, non_null, nulls, non_null_pct, n_distinct, samples) of every column
    that a file has. `sheets` has one row for each row of a file, with its cells (column, kind, value); a row without cells counts
    as a row. A column that some rows of a file lack is null in them. Values of other kinds are different ones.

    One scan: cells collapse map-side to one row per file, column and value; windows for the samples see the first ones of each
    salt only, so a file or column of any size is no single task.
    """
    each = sheets.select(file, F.col(row).alias("_row"), F.posexplode_outer(cells).alias("_pos", "c"))
    values = each.groupBy(file, "c.column", "c.kind", "c.value").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"), F.min("_pos").alias("pos"))
    values = checkpointed(values)
    sizes = sheets.groupBy(F.col(file).alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    some = F.col("value").isNotNull()
    sums = values.filter("column is not null").groupBy(file, "column").agg(
        F.min("pos").alias("_pos"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("non_null"), F.count("value").alias("n_distinct"),
        F.collect_set(F.when(some, F.col("kind"))).alias("_kinds"),
    )
    known = values.filter("value is not null").withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("first", "value", "kind"))
    known = known.withColumn("_r", rank(file, "column", "_salt")).filter(F.col("_r") <= top)
    known = known.withColumn("_r", rank(file, "column")).filter(F.col("_r") <= top)
    pairs = F.array_sort(F.collect_list(F.struct("_r", F.left("value", F.lit(30)).alias("v"))))
    samples = known.groupBy(F.col(file).alias("_f"), F.col("column").alias("_c")).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), ", ").alias("samples"))
    out = sums.join(sizes, F.col(file).eqNullSafe(F.col("_file"))).join(samples, F.col(file).eqNullSafe(F.col("_f")) & (F.col("column") == F.col("_c")), "left")
    out = out.withColumn("nulls", F.col("_rows") - F.col("non_null"))
    place = F.row_number().over(Window.partitionBy(file).orderBy("_pos", "column"))  # a file's columns, not its rows
    return out.select(
        file, "column", place.alias("place"), _dtype(F.col("_kinds"), F.col("nulls"), F.col("_rows")).alias("kind"), "non_null", "nulls",
        percent(F.col("non_null"), F.col("_rows")).alias("non_null_pct"), "n_distinct", "samples",
    )


def raw_value(kind: Column, value: Column) -> Column:
    """PRJ-10: dates in ISO form, everything else as its text, missing stays null."""
    return F.when(kind == "date", F.replace(value, F.lit(" "), F.lit("T"))).otherwise(value)


def raw_samples(sheets: DataFrame, file: str, row: str, cells: str = "cells", top: int = MAX_SAMPLES) -> DataFrame:
    """PRJ-10/12, LIM-1: (file, place, pos, column, value) of the first rows of each file as they are displayed: headers cut to 15,
    values to 20 characters, newlines as spaces, bars as slashes. The row limit is applied map-side, before the window's shuffle."""
    text = F.to_json(F.col(cells))
    rank = F.row_number().over(Window.partitionBy(file).orderBy(row, "_text"))
    first = sheets.select(file, row, cells, text.alias("_text")).withColumn("place", rank).filter(F.col("place") <= top)
    each = first.select(file, "place", F.posexplode(cells).alias("pos", "c"))
    return each.select(file, "place", "pos", display(F.col("c.column"), 15).alias("column"), display(raw_value(F.col("c.kind"), F.col("c.value")), 20, bars=True).alias("value"))


def campus_totals(histogram: DataFrame, file: str) -> DataFrame:
    """AGG-14, SRT-4: (place, campus, n): the histograms of all files together, largest first, ties in order of first appearance (files in
    the order of their names)."""
    merged = histogram.groupBy("campus").agg(F.sum("n").alias("n"), F.min(F.struct(file, "place")).alias("_first"))
    return numbered(merged, [], [F.desc("n"), F.col(f"_first.{file}"), F.col("_first.place")], "place").select("place", "campus", "n")


def campus_histogram(records: DataFrame, file: str, order: str) -> DataFrame:
    """AGG-6: (file, campus, n, place): rows per non-empty campus; place counts campuses by first appearance."""
    counts = records.filter("campus <> ''").groupBy(file, "campus").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(file).orderBy("_first", "campus"))
    return counts.withColumn("place", place).drop("_first")


def file_statistics(records: DataFrame, file: str) -> DataFrame:
    """AGG-7..12, 21: one row per file."""
    some = lambda c: blank_to_null(F.col(c))
    good = F.when(F.col("duration_minutes") > 0, F.col("duration_minutes"))
    average = (F.sum(good).cast("decimal(18,0)") / F.count(good).cast("decimal(18,0)")).cast("decimal(20,8)")
    stats = records.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("parse_error").isNull()).alias("parsed"),
        F.count_if(F.col("parse_error").isNotNull()).alias("failed"),
        F.min(some("date")).alias("first_date"), F.max(some("date")).alias("last_date"),
        F.when(F.count(good) > 0, F.bround(average, 1).cast("double")).otherwise(0.0).alias("avg_minutes"),
    )
    # distinct counts from (file, column, value) in one narrow shuffle, instead of copying every row for each of them
    names = {"class_name": "classes", "course_name": "courses"}
    values = unpivot(records.select(file, *[some(c).alias(c) for c in names]), list(names), [file]).filter("value is not null").distinct()
    counts = values.groupBy(F.col(file).alias("_file")).agg(*[F.count_if(F.col("column") == c).alias(n) for c, n in names.items()])
    stats = stats.join(counts, F.col(file).eqNullSafe(F.col("_file")), "left").drop("_file").fillna(0, list(names.values()))
    span = F.coalesce(F.concat("first_date", F.lit(" ~ "), "last_date"), F.lit("N/A"))
    return stats.withColumns({"date_range": span, "has_errors": F.col("failed") > 0})


def overall_statistics(stats: DataFrame) -> DataFrame:
    """AGG-13..16: sums over files (distinct counts are over-counted, hence ~), the range over all files (N/A unless it
    has two different ends) and the success rate."""
    whole = F.sum("parsed") + F.sum("failed")
    lo, hi = F.min("first_date"), F.max("last_date")
    out = stats.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("classes"), F.lit(0)).alias("classes_approx"), F.coalesce(F.sum("courses"), F.lit(0)).alias("courses_approx"),
        F.when(lo != hi, F.concat(lo, F.lit(" ~ "), hi)).otherwise("N/A").alias("date_range"), F.coalesce(whole, F.lit(0)).alias("_all"),
    )
    rate = F.concat(F.col("parsed").cast("string"), F.lit("/"), F.col("_all").cast("string"), F.lit(" ("), percent(F.col("parsed"), F.col("_all")).cast("string"), F.lit("%)"))
    return out.withColumn("success", rate).drop("_all")


def first_errors(records: DataFrame, file: str, order: str, raw: str = "raw_time", top: int = MAX_ERRORS) -> DataFrame:
    """AGG-11, LIM-2: (file, place, message, more): the first `top` errors of each file and how many there are beyond."""
    bad = records.filter("parse_error is not null")
    # the row limit is applied map-side before the window's shuffle; the counts are partial sums: a file may hold any share
    rank = F.row_number().over(Window.partitionBy(file).orderBy(order, raw))
    ranked = bad.select(file, order, "parse_error", raw, rank.alias("place")).filter(F.col("place") <= top)
    counts = bad.groupBy(F.col(file).alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat(F.lit("Row "), F.col(order).cast("string"), F.lit(": "), "parse_error", F.lit(" (Raw: '"), F.col(raw), F.lit("')"))
    joined = ranked.join(counts, F.col(file).eqNullSafe(F.col("_file")))
    return joined.select(file, "place", text.alias("message"), F.greatest(F.col("_n") - top, F.lit(0)).alias("more"))
