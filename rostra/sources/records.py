"""SRC-8..11: earlier results and metadata, all of them optional."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.schema import RECORD_SCHEMA

MANIFEST = T.StructType([
    T.StructField("generated_at", T.StringType()), T.StructField("files_processed", T.ArrayType(T.StringType())),
    T.StructField("total_records", T.LongType()), T.StructField("source_url", T.StringType()), T.StructField("source_title", T.StringType()),
])
SOURCE = T.StructType([
    T.StructField("source_url", T.StringType()), T.StructField("source_title", T.StringType()),
    T.StructField("downloaded_files", T.ArrayType(T.StringType())), T.StructField("updated_at", T.StringType()),
])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8/10: one JSON array of records, or a folder of JSON lines, under the fixed schema (no inference)."""
    return spark.read.schema(RECORD_SCHEMA).option("multiLine", "true").json(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-9/11: one JSON object; a missing or damaged file gives no row."""
    try:
        df = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
        df.take(1)
        return df
    except (AnalysisException, PySparkException):
        return spark.createDataFrame([], schema)


def json_cells(payload: Column) -> Column:
    """The cells of a row delivered as a JSON object, in its order: array of (column, kind, value), as workbooks have them. Nested
    values are JSON text of kind object; a null cell has neither kind nor value. Null for anything but an object."""
    def cell(e: Column) -> Column:
        shape = F.schema_of_variant(e["value"])
        kind = (
            F.when(shape == "VOID", None).when(shape == "STRING", "str").when(shape == "BOOLEAN", "bool").when(shape == "BIGINT", "int")
            .when(shape.rlike("^(ARRAY|OBJECT)"), "object").otherwise("float")
        )
        text = F.when(shape.rlike("^(ARRAY|OBJECT)"), F.to_json(e["value"])).otherwise(F.try_variant_get(e["value"], "$", "string"))
        return F.struct(e["key"].alias("column"), kind.alias("kind"), text.alias("value"))

    return F.transform(F.map_entries(F.from_json(payload, "map<string,variant>")), cell)


def source_of(manifest: DataFrame) -> DataFrame:
    """PRJ-19: empty url and title become null."""
    return manifest.withColumns({c: F.nullif(c, F.lit("")) for c in ("source_url", "source_title")})


def read_newest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-13: the data set of the first path that can be read and has rows; the others are older snapshots to fall back
    on. An error if none can."""
    for path in paths:
        try:
            df = read_dataset(spark, path)
            if not df.filter("id is not null").isEmpty():
                return df
        except (AnalysisException, PySparkException):
            continue
    raise FileNotFoundError(f"no readable data set among {paths}")
