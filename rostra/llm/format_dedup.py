"""Problem 7: duplicates hidden by formatting differences, by progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.session import checkpointed, skew_safe_join

FIELDS = ["course_code", "class_name", "raw_time", "location"]
_SEP = "\x01"


def _stripped(fields: list[Column]) -> Column:
    """The letters and digits of all fields in lower case, in one pass, with a separator between the fields."""
    bare = [F.when(F.contains(c, F.lit(_SEP)), F.translate(c, _SEP, "")).otherwise(c) for c in fields]
    return F.lower(F.regexp_replace(F.concat_ws(_SEP, *bare), rf"[^\p{{L}}\p{{Nd}}{_SEP}]+", ""))


def _histogram(c: Column) -> Column:
    """Fingerprint of how often each character occurs, whatever the order: the sum of a 40-bit hash of each one. It is never
    null, as the plan can tell, so that a join on it needs no filter, which would compute it once more."""
    total = F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: a + F.xxhash64(x).bitwiseAND(F.lit((1 << 40) - 1)))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def entry_classes(df: DataFrame, row_id: str = "listing_id", fields: list[str] = FIELDS) -> DataFrame:
    """(row_id, first_id, copies) of every row that has at least one copy: rows are copies if their fields hold the
    same letters and digits (case aside, null as empty), the values in any order. first_id is the smallest id of
    the class, copies the number of its rows. Rows with nothing but blanks are copies of each other; rows without
    id are left out; further columns are ignored. Ids are unique; a repeated id counts as a row each time.

    Refinement: (1) all rows fall into classes of equal stripped length and letter histogram, which need no sort and
    no comparison of values; (2) only rows of classes with several members get the costlier key, the sorted values
    themselves, hashed to 128 bits. Every step aggregates map-side; rows meet their class in joins that split classes
    with many rows, so one entry may own a third of all rows.
    """
    text = _stripped([F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    rows = df.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), text.alias("_text"))
    cheap = rows.withColumns({"_len": F.length("_text"), "_hist": _histogram(F.col("_text"))})
    # 24 bytes for each class of several, used for the size of the hot ones and for the join
    several = checkpointed(cheap.groupBy("_len", "_hist").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    total = several.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    members = skew_safe_join(cheap, several, ["_len", "_hist"], "_n", "_id", total)
    key = F.concat_ws(_SEP, F.array_sort(F.split("_text", _SEP)))
    keyed = members.select("_id", key.alias("_key")).select("_id", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit("2"), F.col("_key"), F.length("_key")).alias("_k2"))
    keyed = checkpointed(keyed)  # 24 bytes a row, used for the classes and for their rows
    classes = keyed.groupBy("_k1", "_k2").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    out = skew_safe_join(keyed, classes, ["_k1", "_k2"], "copies", "_id", total)
    return out.select(F.col("_id").alias(row_id), "first_id", "copies")


def hidden_copies(df: DataFrame) -> DataFrame:
    """(first_id, copy_id): one row for each copy but the one with the smallest listing_id."""
    classes = entry_classes(df)
    return classes.filter("listing_id <> first_id").select("first_id", F.col("listing_id").alias("copy_id")).distinct()


def collapsed_entries(df: DataFrame) -> DataFrame:
    """The table with every entry once, as its row of the smallest listing_id writes it, and its number of copies. Of rows that
    share one id the smallest in code-point order stays; rows without an id stay each by itself, with one copy."""
    copies = entry_classes(df)
    firsts = copies.filter("listing_id = first_id").groupBy("listing_id").agg(F.max("copies").alias("copies"))
    later = copies.filter("listing_id <> first_id").select("listing_id")
    kept = df.select("listing_id", *FIELDS).withColumn("_row", F.when(F.col("listing_id").isNull(), F.monotonically_increasing_id()))
    kept = kept.join(later, "listing_id", "left_anti").join(firsts, "listing_id", "left")
    one = kept.groupBy("listing_id", "_row").agg(F.min(F.struct(*FIELDS)).alias("r"), F.max("copies").alias("copies"))
    return one.select("listing_id", *[F.col(f"r.{f}").alias(f) for f in FIELDS], F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
