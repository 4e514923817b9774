"""WIN-1/2, SRT-1: row numbers within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.session import checkpointed


def numbered(df: DataFrame, group: list[str], order: list, name: str, start: int = 1) -> DataFrame:
    """All rows with `name`: their number within the group, from `start` on, in `order` (columns or their names).

    Rows are range-sorted by group and order, so that a group of any size spreads over as many partitions as it fills, and
    checkpointed, since counts and numbers must see the same partitions. One summary row per partition goes to the driver
    (its first and last group and how many rows they have there); prefix-combined they give what precedes a
    partition's first group. Equal rows share a partition and get consecutive numbers. Null is a group of its own.
    """
    keys = [*[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*df.columns)]
    ordered = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = ordered.withColumns({"_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    per_group = placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    row = F.struct(*group, "_n")
    summary = per_group.groupBy("_pid").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("groups")).collect()
    offsets, before = [], (None, 0)  # the group that was last so far, and its rows
    for s in sorted(summary, key=lambda s: s["_pid"]):
        first, last = tuple(s["first"])[:-1], tuple(s["last"])[:-1]
        ahead = before[1] if before[0] == first else 0
        offsets.append((s["_pid"], *first, ahead))
        before = (last, s["last"]["_n"] + (ahead if s["groups"] == 1 else 0))
    fields = [T.StructField("_p", T.IntegerType()), *[T.StructField(f"_g{i}", df.schema[g].dataType) for i, g in enumerate(group)], T.StructField("_ahead", T.LongType())]
    ahead = F.broadcast(df.sparkSession.createDataFrame(offsets, T.StructType(fields)))  # one row per partition
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = F.row_number().over(Window.partitionBy("_pid", *group).orderBy("_pos"))
    out = placed.join(ahead, same, "left").withColumn(name, (local + F.coalesce("_ahead", F.lit(0).cast("bigint")) + (start - 1)).cast("bigint"))
    return out.select(*df.columns, name)
