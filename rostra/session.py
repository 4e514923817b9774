"""Session helpers: reading tables, the shared checkpoint folder, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir, which all executors share. Where it is unset, a run on this machine alone
    (tests) gets a folder of its own; on a cluster that is an error, since executors would write to different disks."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "rostra-checkpoint"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder; partitions and their order stay as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete what this session has checkpointed so far, once the results made from it are written. Spark does so by itself,
    as plans are forgotten, with spark.cleaner.referenceTracking.cleanCheckpoints=true."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder.get())
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            fs.delete(status.getPath(), True)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast hint only after counting that the side holds at most max_rows; beyond that the
    planner's own shuffle join is used."""
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).collect()) <= max_rows else df


def skew_safe_join(
    rows: DataFrame, groups: DataFrame, on: list[str], count_col: str, row_id: str, total: int, hot_rows: int = 200_000
) -> DataFrame:
    """Inner join of many rows to one row per group, where a group may own a large part of all rows.

    `groups` holds one row per key with the number of its rows in `count_col`. Groups of more than
    `limit` rows are hot; there can be at most total/limit <= 100,000 of them, so their keys are broadcast.
    Rows of a hot group are spread over count/limit salts and the group's row is repeated that often:
    no task gets more than about `limit` rows of one key, and no row is dropped.
    """
    limit = max(hot_rows, -(-total // 100_000))
    salted = groups.withColumn("_parts", F.ceil(F.col(count_col) / F.lit(limit)).cast("int"))
    hot = F.broadcast(salted.filter("_parts > 1").select(*on, F.col("_parts").alias("_hot")))
    left = rows.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(row_id), F.col("_hot")).cast("int")).otherwise(0)
    )
    right = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return left.drop("_hot").join(right.drop("_parts"), [*on, "_salt"]).drop("_salt")
