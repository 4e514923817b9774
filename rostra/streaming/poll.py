"""Polling for new files as a stream: what is new since the last run, processed once, then the stream ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rostra.operators.standardize import rename_to_standard, to_records


def standard_stream(sheets: DataFrame, keep: list[str]) -> DataFrame:
    """Standard records of a stream of sheet rows. Stateless: every row is mapped on its own, so there is nothing to
    watermark and late files are simply processed when they come."""
    return to_records(rename_to_standard(sheets, keep))


def poll_folder(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, keep: list[str], format: str = "json") -> StreamingQuery:
    """Process the files that came since the last call and append their records as Parquet to `out`. The checkpoint folder
    remembers which files are done; a failed run is repeated without double rows (the file sink's log is exactly once)."""
    sheets = spark.readStream.schema(schema).format(format).load(folder)
    writer = standard_stream(sheets, keep).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exam_hours(records: DataFrame, time: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """An extension beyond the batch operators: running numbers of records by hour of event time and campus; windows close
    `late` after the newest event, which bounds the state."""
    from pyspark.sql import functions as F

    windowed = records.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "campus")
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "campus", "n")
