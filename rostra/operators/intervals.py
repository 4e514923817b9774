"""Problem 3: overlapping, nested and gapped intervals per entity, without one task per entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.civil import clock_text
from rostra.functions.text import strip
from rostra.session import checkpointed


def stamp_micros(stamp: Column) -> Column:
    s = strip(stamp)
    zoned = F.when(s.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("+08:00")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def _running_end(pdf: pd.DataFrame, entity, end, start) -> tuple[pd.Series, pd.Series]:
    """(first row of an entity, largest end so far of the same entity before the row), with carried state."""
    first = pdf["entity"].ne(pdf["entity"].shift())
    first.iloc[0] = pdf["entity"].iloc[0] != entity
    block = first.cumsum()
    seen = pdf["end_us"].groupby(block).cummax().groupby(block).shift()
    if not first.iloc[0]:  # the carried end counts for the whole leading block
        lead = block == 0
        seen[lead] = seen[lead].fillna(end).clip(lower=end)
    return first, seen


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for a partition: its first and last entity, and of the last one the largest end and the
    start of the last island as it is without anything carried in."""
    from pyspark import TaskContext

    head, entity, end, start = None, None, 0, 0
    for pdf in batches:
        if not len(pdf):
            continue
        head = pdf["entity"].iloc[0] if head is None else head
        first, seen = _running_end(pdf, entity, end, start)
        opens = first | (pdf["start_us"] > seen)
        tail = pdf[pdf["entity"] == pdf["entity"].iloc[-1]]
        same = entity == pdf["entity"].iloc[-1]
        entity, end = pdf["entity"].iloc[-1], max(int(tail["end_us"].max()), end if same else -(2**62))
        opened = tail["start_us"][opens[tail.index]]
        start = int(opened.iloc[-1]) if len(opened) else start
    if head is not None:
        yield pd.DataFrame([[TaskContext.get().partitionId(), head, entity, end, start]], columns=["pid", "head", "entity", "end_us", "start_us"])


def _combine(summaries: list) -> dict[int, tuple[str, int, int]]:
    """State carried into each partition: entity, largest end and island start of what came before."""
    carried, state = {}, None
    for s in sorted(summaries, key=lambda s: s.pid):
        if state:
            carried[s.pid] = state
        if state and state[0] == s.entity:  # the whole partition belongs to the carried entity
            bridged = s.start_us <= state[1]
            state = (s.entity, max(state[1], s.end_us), state[2] if bridged else s.start_us)
        else:
            state = (s.entity, s.end_us, s.start_us)
    return carried


def busy_periods(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """(entity, kind, start_us, end_us, n): of rows (entity, start_us, end_us) the islands of overlapping, nested
    or touching intervals (kind 'island', n different intervals) and the gaps between them (kind 'gap').

    Rows with a null or with an end that isn't later than its start are left out; repeated rows count once; an
    empty input gives no rows.

    Three steps, none of which needs an entity in one task: (1) repeats collapse, and all rows are range-sorted
    by entity and start, so that a hot entity spreads over many partitions; the sorted rows are checkpointed,
    since both scans must see the same partitions; (2) each partition gives one summary row (its last entity's
    largest end and island start), and the summaries, as many as partitions, are prefix-combined on the driver;
    (3) each partition is scanned again with the state carried into it and labels its islands by their true
    start; pieces of an island that crosses partitions meet in a final aggregation.
    """
    clean = df.select("entity", "start_us", "end_us").filter("entity is not null and end_us > start_us").distinct()
    keys = [F.col("entity"), F.col("start_us"), F.col("end_us")]
    ranged = clean.repartitionByRange(partitions, *keys) if partitions else clean.repartitionByRange(*keys)
    ordered = checkpointed(ranged.sortWithinPartitions(*keys))
    summary = ordered.mapInPandas(_summarise, "pid int, head string, entity string, end_us bigint, start_us bigint")
    carried = df.sparkSession.sparkContext.broadcast(_combine(summary.collect()))

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        entity, end, start = carried.value.get(TaskContext.get().partitionId(), (None, 0, 0))
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.reset_index(drop=True)
            first, seen = _running_end(pdf, entity, end, start)
            opens = first | (pdf["start_us"] > seen)
            label = pdf["start_us"].where(opens).astype("Int64").ffill().fillna(start).astype("int64")
            parts = pdf.assign(label=label).groupby(["entity", "label"], sort=False)["end_us"].agg(["max", "size"]).reset_index()
            parts.columns = ["entity", "start_us", "end_us", "n"]
            yield parts.assign(kind="island")[["entity", "kind", "start_us", "end_us", "n"]]
            at = opens & ~first
            if at.any():
                yield pd.DataFrame({"entity": pdf["entity"][at], "kind": "gap", "start_us": seen[at].astype("int64"), "end_us": pdf["start_us"][at], "n": 0})
            last = pdf["entity"].iloc[-1]
            of_last = pdf["end_us"][pdf["entity"] == last].max()
            end = int(max(of_last, end)) if last == entity else int(of_last)
            entity, start = last, int(label.iloc[-1])

    pieces = ordered.mapInPandas(rescan, "entity string, kind string, start_us bigint, end_us bigint, n bigint")
    return pieces.groupBy("entity", "kind", "start_us").agg(F.max("end_us").alias("end_us"), F.sum("n").alias("n"))


def class_periods(df: DataFrame) -> DataFrame:
    """(class_name, kind, start_timestamp, end_timestamp): 'merged' periods of at least two different intervals and
    'gap's between periods of a class within one date at +08:00. Null or empty classes, rows without two readable
    stamps and rows whose end isn't later than the start don't count."""
    rows = df.select(F.nullif("class_name", F.lit("")).alias("entity"), stamp_micros(F.col("start_timestamp")).alias("start_us"), stamp_micros(F.col("end_timestamp")).alias("end_us"))
    local = lambda c: F.floor(F.col(c) / 1_000_000).cast("bigint") + 8 * 3600
    day = lambda c: F.floor(local(c) / 86400)
    keep = ((F.col("kind") == "island") & (F.col("n") > 1)) | ((F.col("kind") == "gap") & (day("start_us") == day("end_us")))
    return busy_periods(rows).filter(keep).select(
        F.col("entity").alias("class_name"),
        F.when(F.col("kind") == "island", "merged").otherwise("gap").alias("kind"),
        F.concat(clock_text(local("start_us")), F.lit("+08:00")).alias("start_timestamp"),
        F.concat(clock_text(local("end_us")), F.lit("+08:00")).alias("end_timestamp"),
    )
