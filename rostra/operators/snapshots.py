"""Problem 1: what changed between full snapshots, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions.text import strip
from rostra.operators.ranking import numbered

_SHIFT = "18446744073709551616"  # 2^64


def _instant(stamp: Column) -> Column:
    """Microseconds of an ISO stamp; a stamp without an offset is at +08:00; unreadable ones are null."""
    s = strip(stamp)
    zoned = F.when(s.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("+08:00")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def wall_micros(df: DataFrame, column: str) -> Column:
    """Microseconds that order a time column; of one without zone the wall clock, free of the session's zone."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        clock = F.hour(c).cast("bigint") * 3600 + F.minute(c) * 60
        return (F.unix_date(c.cast("date")).cast("bigint") * 86400 + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.unix_micros(c.cast("timestamp"))


def exam_state(df: DataFrame) -> Column:
    """Hash of what makes a record another one: start instant and cleaned location (null equals empty)."""
    place = F.coalesce(strip(F.translate("location", "\xa0", " ")), F.lit(""))
    return F.xxhash64(_instant(df["start_timestamp"]), place)


def _ordinals(df: DataFrame, snapshot: str, most: int = 10_000) -> DataFrame:
    """(_s, _o): the snapshot numbers present, counted from 1. Up to `most` of them, one row per delivery, are read once
    and broadcast as a local table; beyond that they stay distributed and are numbered by a range sort with carried
    state, without a broadcast."""
    numbers = df.select(F.col(snapshot).alias("_s")).filter("_s is not null").distinct()
    present = sorted(r["_s"] for r in numbers.limit(most + 1).collect())
    if len(present) > most:
        return numbered(numbers, [], ["_s"], "_o")
    kind = numbers.schema["_s"].dataType.simpleString()
    return F.broadcast(df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(present, 1)], f"_s {kind}, _o int"))


def validity_intervals(
    df: DataFrame, state: Column, key: str = "id", snapshot: str = "snapshot_no", version: str = "ingested_at"
) -> tuple[DataFrame, DataFrame]:
    """(intervals, ordinals): the maximal runs of consecutive snapshots in which a key keeps one state.

    intervals: key, state, first_ord, last_ord; ordinals: ord, snapshot. Of a key occurring more than once in
    a snapshot the row with the latest version counts (null versions are oldest, ties go to the larger hash,
    so the result doesn't depend on row order). Rows without key or snapshot number are left out.

    Plan: one aggregation by (key, snapshot) whose map-side part collapses repeats, so a key repeated millions
    of times never meets in one task; then one exchange by key that serves both windows and the interval
    aggregation, since all of them cluster on a superset of it.
    """
    base = df.select(
        F.col(key).alias("_k"), F.col(snapshot).alias("_s"), state.alias("_h"),
        F.coalesce(wall_micros(df, version), F.lit(-(2**62))).alias("_v"),
    ).filter("_k is not null and _s is not null")
    order = F.col("_v").cast("decimal(20,0)") * F.lit(_SHIFT).cast("decimal(20,0)") + F.col("_h").cast("decimal(20,0)")
    latest = base.groupBy("_k", "_s").agg(F.max_by("_h", order.cast("decimal(38,0)")).alias("_h"))
    ordinals = _ordinals(df, snapshot)
    dated = latest.join(ordinals, "_s").select("_k", "_h", "_o").repartition("_k")
    run = F.col("_o") - F.row_number().over(Window.partitionBy("_k", "_h").orderBy("_o"))
    intervals = (
        dated.withColumn("_run", run)
        .groupBy("_k", "_h", "_run")
        .agg(F.min("_o").alias("first_ord"), F.max("_o").alias("last_ord"))
        .select(F.col("_k").alias(key), F.col("_h").alias("state"), "first_ord", "last_ord")
    )
    return intervals, ordinals.select(F.col("_o").alias("ord"), F.col("_s").alias(snapshot))


def snapshot_changes(
    df: DataFrame, state: Column, key: str = "id", snapshot: str = "snapshot_no", version: str = "ingested_at"
) -> DataFrame:
    """(snapshot, key, change): one row for each key that a snapshot other than the first adds, removes or changes.

    Interval starts without an adjacent earlier interval are additions, adjacent intervals are changes, ends
    without an adjacent later interval are removals at the next snapshot. Empty input and input of a single
    snapshot give no rows; further columns of any name are ignored.
    """
    intervals, ordinals = validity_intervals(df, state, key, snapshot, version)
    w = Window.partitionBy(key).orderBy("first_ord")
    before, after = F.lag("last_ord").over(w), F.lead("first_ord").over(w)
    start = F.when(F.col("before") == F.col("first_ord") - 1, "changed").otherwise("added")
    events = F.array(
        F.when(F.col("first_ord") > 1, F.struct(F.col("first_ord").alias("ord"), start.alias("change"))),
        F.when(
            F.col("after").isNull() | (F.col("after") > F.col("last_ord") + 1),
            F.struct((F.col("last_ord") + 1).alias("ord"), F.lit("removed").alias("change")),
        ),
    )
    # an end at the last snapshot has no ordinal after it: the join with the ordinals drops that event
    return (
        intervals.withColumns({"before": before, "after": after})
        .select(key, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
        .select(key, "e.ord", "e.change")
        .join(ordinals, "ord")
        .select(snapshot, key, "change")
    )
