"""SNK-1..3, 5, 8, PRJ-9..12: data set, manifest and quality report at the edge."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions.display import display
from rostra.operators.ingest import first_row_per, rows_differ
from rostra.operators.quality import campus_histogram, campus_totals, file_statistics, first_errors, overall_statistics, raw_samples, sheet_profile
from rostra.operators.standardize import resolve_by_join
from rostra.schema import ALIASES, MAX_ERRORS, MAX_SAMPLES, RECORD_FIELDS
from rostra.session import checkpointed
from rostra.sources.files import hadoop_paths, swap_in

#: Fields of the processed sample.
SAMPLE_FIELDS = ["class_name", "course_name", "campus", "start_timestamp", "location", "teacher", "count"]


def record_json(df: DataFrame) -> Column:
    """SNK-1: one record as compact JSON in schema order, nulls kept."""
    return F.to_json(F.struct(*[F.col(f) for f in RECORD_FIELDS]), {"ignoreNullFields": "false"})


def write_dataset(records: DataFrame, path: str, order: list[str]) -> bool:
    """SNK-1/8: records as JSON lines under `path`, in order, unless they are unchanged. True if written. The new folder
    replaces the old one only when it is complete; an empty result never replaces data."""
    spark = records.sparkSession
    if records.isEmpty():
        raise ValueError("refusing to replace the data set by an empty one")
    fs, old = hadoop_paths(spark, path)
    if fs.exists(old):
        before = spark.read.schema(records.select(*RECORD_FIELDS).schema).json(path)
        if rows_differ(before, records.select(*RECORD_FIELDS)).first()["equal"]:
            return False
    records.orderBy(*order).select(record_json(records).alias("value")).write.mode("overwrite").text(path + ".new")
    swap_in(spark, path + ".new", path)
    return True


def dataset_array(records: DataFrame, order: list[str]) -> str:
    """SNK-1 for small results: the JSON array as one text."""
    rows = records.orderBy(*order).select(record_json(records).alias("j")).toLocalIterator()
    return "[" + ",".join(r.j for r in rows) + "]"


def manifest(records: DataFrame, file: str, generated_at: str, source: DataFrame | None = None) -> DataFrame:
    """SNK-3, JOIN-5: one row; url and title only where there is source metadata. Two levels, so that only file names
    meet in one task."""
    per_file = records.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    out = per_file.agg(F.array_sort(F.collect_list(file)).alias("files_processed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"))
    out = out.select(F.lit(generated_at).alias("generated_at"), "files_processed", "total_records")
    if source is None:
        return out
    return out.join(F.broadcast(source.select("source_url", "source_title").limit(1)), F.lit(True), "left")


def write_metadata(path: str, url: str, title: str, files: list[str], updated_at: str) -> None:
    """SNK-5, by rename."""
    with open(path + ".new", "w", encoding="utf8") as f:
        json.dump({"source_url": url, "source_title": title, "downloaded_files": files, "updated_at": updated_at}, f, ensure_ascii=False, indent=2)
    os.replace(path + ".new", path)


def _row(*cells: Column | str) -> Column:
    """A line of a table; a missing cell is an empty one."""
    texts = [F.lit(c) if isinstance(c, str) else F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), *[x for t in texts for x in (t, F.lit(" | "))][:-1], F.lit(" |"))


def quality_report(sheets: DataFrame, records: DataFrame, file: str, order: str, now: str) -> DataFrame:
    """SNK-2: (file, block, line, text): the lines of the Markdown report, in the order of these columns; the file of the summary is
    null. `sheets` has the rows as delivered with their cells (column, kind, value), `records` the processed ones; both
    name their file in `file` and their row in `order`. One plan for all files, whatever their number: every part is aggregated
    by file in Spark, and a line is a row. A file has the columns it was delivered with, not those of others."""
    sheets = sheets.filter(F.col(file).isNotNull())
    records = records.filter(F.col(file).isNotNull())
    stats = checkpointed(file_statistics(records, file))  # one row a file
    histogram = checkpointed(campus_histogram(records, file, order))
    profile = checkpointed(sheet_profile(sheets, file, order))  # one row a file and column
    total = overall_statistics(stats)
    name = F.col(file)

    def lines(df: DataFrame, block: int, line: Column, *texts: Column | str, of: Column = name) -> DataFrame:
        each = [F.struct(F.lit(i).alias("i"), (F.lit(t) if isinstance(t, str) else t).alias("text")) for i, t in enumerate(texts)]
        part = df.select(of.alias("file"), F.lit(block).alias("block"), line.cast("bigint").alias("at"), F.inline(F.array(*each)))
        return part.select("file", "block", (F.col("at") * 1000 + F.col("i")).alias("line"), "text")

    head = lambda df, block, *titles: lines(df, block, F.lit(-1), "", _row(*titles), _row(*["---"] * len(titles)))
    number = lambda c: F.format_number(c, 0)
    nobody = F.lit(None).cast("string")
    campuses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("campus", F.lit(" ("), number("n"), F.lit(")")).alias("t")))), lambda x: x["t"]), ", ")
    everywhere = campus_totals(histogram, file).agg(campuses.alias("campuses"))
    here = histogram.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("campus", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]), ", ").alias("campuses"))
    resolved = resolve_by_join(profile.select(file, "column"), _alias_table(sheets.sparkSession), [file])
    tried = F.element_at(F.create_map(*[F.lit(x) for f, names in ALIASES.items() for x in (f, "_(tried: " + ", ".join(names[:3]) + ")_")]), F.col("field"))
    at = F.array_position(F.array(*map(F.lit, ALIASES)), F.col("field"))
    errors = first_errors(records, file, order)
    rest = errors.filter("place = 1 and more > 0")
    raw = raw_samples(sheets, file, order)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"]), " | ")
    raw_rows = raw.groupBy(file, "place").agg(joined(F.col("column")).alias("names"), joined(F.col("value")).alias("values"), F.count(F.lit(1)).alias("n"))
    samples = first_row_per(records, [file], [order], MAX_SAMPLES, "place")
    status = F.when(F.col("has_errors"), "⚠️").otherwise("✅")
    widths = profile.groupBy(file).agg(F.count(F.lit(1)).alias("columns"))
    of_file = stats.join(widths, file, "left").join(here, file, "left")
    parts = [
        lines(total, 0, F.lit(0), "# Data inventory and quality", "", f"> Generated on {now} (UTC+8)", "", "## Summary", "", _row("Metric", "Value"), _row("---", "---"),
              _row("Files", number("files")), _row("Records", number("records")), _row("Parsed", F.col("success")), _row("Dates", F.col("date_range")),
              _row("Classes", F.concat(F.lit("~"), number("classes_approx"))), _row("Courses", F.concat(F.lit("~"), number("courses_approx"))), of=nobody),
        lines(everywhere, 1, F.lit(0), _row("Campuses", F.col("campuses")), of=nobody),
        lines(of_file, 2, F.lit(0), "", F.concat(F.lit("## "), status, F.lit(" `"), name, F.lit("`")), "",
              F.concat(F.lit("Rows "), number("n_rows"), F.lit(", columns "), F.coalesce("columns", F.lit(0)).cast("string"), F.lit(", parsed "), F.col("parsed").cast("string"), F.lit("/"), F.col("n_rows").cast("string"), F.lit(", dates "), F.col("date_range"))),
        head(widths, 3, "#", "Column", "Type", "Non-null %", "Distinct", "Samples"),
        lines(profile, 3, F.col("place"), _row(F.col("place"), F.concat(F.lit("`"), "column", F.lit("`")), F.col("kind"), F.col("non_null_pct"), number("n_distinct"), display(F.col("samples"), 50, bars=True))),
        head(widths, 4, "Field", "Column", "Status"),
        lines(resolved, 4, at, _row(F.concat(F.lit("`"), "field", F.lit("`")), F.when(F.col("mapped"), F.concat(F.lit("`"), "column", F.lit("`"))).otherwise(tried), F.when(F.col("mapped"), "mapped").otherwise("not found"))),
        head(of_file, 5, "Metric", "Value"),
        lines(of_file, 5, F.lit(0), _row("Classes", number("classes")), _row("Courses", number("courses")), _row("Average minutes", F.col("avg_minutes")), _row("Campuses", F.col("campuses"))),
        lines(stats.filter("has_errors"), 6, F.lit(-1), "", F.concat(F.col("failed").cast("string"), F.lit(" rows with parsing issues:")), ""),
        lines(errors, 6, F.col("place"), F.concat(F.lit("- "), "message")),
        lines(rest, 6, F.lit(MAX_ERRORS + 1), F.concat(F.lit("- _and "), F.col("more").cast("string"), F.lit(" more_"))),
        lines(raw_rows.filter("place = 1"), 7, F.lit(-1), "", F.concat(F.lit("| "), "names", F.lit(" |")), F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))),
        lines(raw_rows, 7, F.col("place"), F.concat(F.lit("| "), "values", F.lit(" |"))),
        head(stats, 8, *SAMPLE_FIELDS),
        lines(samples, 8, F.col("place"), _row(*[display(F.col(c).cast("string"), 25) for c in SAMPLE_FIELDS])),
    ]
    return reduce(DataFrame.unionByName, parts)


def _alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, i, a) for f, names in ALIASES.items() for i, a in enumerate(names)], "field string, alias_pos int, alias string")


def write_report(report: DataFrame, path: str) -> None:
    """The report as one text file of a single, ordered stream of lines, by rename."""
    with open(path + ".new", "w", encoding="utf8") as f:
        for r in report.orderBy(F.col("file").asc_nulls_first(), "block", "line").toLocalIterator():
            f.write(r["text"] + "\n")
    os.replace(path + ".new", path)
