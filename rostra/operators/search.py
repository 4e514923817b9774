"""FLT-6..12, AGG-17..19, SRT-1/2, LIM-3, SEM-6: class search and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions.display import CARD_DEFAULTS, card_field, display_date
from rostra.functions.text import strip
from rostra.schema import MAX_CLASSES, MIN_TERM
from rostra.session import broadcast_if_small

EMPTY, NOT_FOUND, DETAIL, LIST = "EMPTY", "NOT_FOUND", "DETAIL", "LIST"


def matches(class_name: Column, term: Column) -> Column:
    """FLT-6: the trimmed upper-case term occurs in the upper-case class name; an all-blank term matches every class."""
    bare = F.btrim(strip(term), F.lit("﻿"))
    return F.contains(F.upper(class_name), F.upper(bare))


def matching_classes(records: DataFrame, term: str) -> DataFrame:
    """FLT-8/9, AGG-17: distinct non-empty classes that match; none if the term, untrimmed, is too short."""
    if len(term) < MIN_TERM:
        return records.select("class_name").limit(0)
    return records.filter((F.col("class_name") != "") & matches(F.col("class_name"), F.lit(term))).select("class_name").distinct()


def listed_classes(records: DataFrame, term: str, top: int = MAX_CLASSES) -> DataFrame:
    """LIM-3, SRT-2: (place, class_name, more): the first classes in code-point order, and how many lie beyond."""
    classes = matching_classes(records, term)
    n = classes.agg(F.count(F.lit(1)).alias("_n"))
    first = classes.orderBy("class_name").limit(top)  # top-k per partition, then merged
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("class_name")))
    return ranked.join(F.broadcast(n)).select("place", "class_name", F.greatest(F.col("_n") - top, F.lit(0)).alias("more"))


def search_modes(records: DataFrame, terms: DataFrame) -> DataFrame:
    """AGG-18, FLT-7: (term, chosen) to (term, chosen, mode, classes, exams) for a list of searches at once.

    A chosen class goes first and gives DETAIL even without exams; else the number of matching classes decides:
    0 NOT_FOUND, 1 DETAIL, more LIST; a term shorter than two characters (or null) gives EMPTY. exams is what DETAIL shows. Searches repeated
    come out repeated. Any number of searches: classes and terms meet by equality, of the chosen class or of the
    first two characters of the term, never each with each.
    """
    by_class = records.filter("class_name <> ''").groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    asked = terms.select("term", "chosen").withColumn("_active", F.coalesce(F.length("term") >= MIN_TERM, F.lit(False)))
    live = asked.filter("_active").distinct()
    bare = lambda c: F.upper(F.btrim(strip(c), F.lit("\ufeff")))
    # a term of one character or more meets only the classes that hold its first two
    upper = F.upper("class_name")
    grams = F.transform(F.sequence(F.lit(1), F.length(upper)), lambda i: F.substring(upper, i, F.lit(2)))
    every = F.concat(grams, F.transform(grams, lambda g: F.left(g, F.lit(1))))
    by_gram = by_class.withColumn("_gram", F.explode(F.array_distinct(every)))
    typed = live.filter("chosen is null").withColumn("_bare", bare(F.col("term")))
    inside = by_gram.join(typed.withColumn("_gram", F.left("_bare", F.lit(2))), "_gram").filter(F.contains(F.upper("class_name"), F.col("_bare")))
    exact = by_class.join(live.filter("chosen is not null"), F.col("class_name") == F.col("chosen"))
    found = inside.select("term", "chosen", "n").unionByName(exact.select("term", "chosen", "n"))
    # a term of nothing but blanks matches every class: one sum, which no class has to meet
    total = by_class.agg(F.count(F.lit(1)).alias("_classes"), F.sum("n").alias("_exams")).withColumn("_one", F.lit(1))
    blank = typed.filter("_bare = ''").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").filter("_classes > 0")
    counts = found.groupBy(F.col("term").alias("_t"), F.col("chosen").alias("_c")).agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("exams"))
    counts = counts.unionByName(blank.select(F.col("term").alias("_t"), F.col("chosen").alias("_c"), F.col("_classes").alias("classes"), F.col("_exams").alias("exams")))
    out = asked.join(counts, F.col("term").eqNullSafe(F.col("_t")) & F.col("chosen").eqNullSafe(F.col("_c")), "left")
    classes = F.coalesce("classes", F.lit(0).cast("bigint"))
    mode = (
        F.when(~F.col("_active"), EMPTY).when(F.col("chosen").isNotNull(), DETAIL).when(classes == 0, NOT_FOUND)
        .when(classes == 1, DETAIL).otherwise(LIST)
    )
    return out.select("term", "chosen", mode.alias("mode"), classes.alias("classes"), F.when(mode == DETAIL, F.coalesce("exams", F.lit(0).cast("bigint"))).alias("exams"))


def in_time_order(records: DataFrame, *tie: str) -> DataFrame:
    """SRT-1: by start, missing starts last, ties in input order."""
    return records.orderBy(F.col("start_timestamp").asc_nulls_last(), *tie)


def class_exams(records: DataFrame, class_name: str) -> DataFrame:
    """The DETAIL result of a class: case-sensitive equality, pushed down to the scan."""
    return in_time_order(records.filter(F.col("class_name") == class_name), "source_file", "row_index")


def selected(records: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """JOIN-1, FLT-10/11: the chosen records that have a start. The choice is broadcast only if it is small."""
    return records.filter("start_timestamp is not null").join(broadcast_if_small(chosen.select(key).distinct()), key, "left_semi")


def share_class(url: Column) -> Column:
    """SRC-12: the decoded class parameter of a URL; null if there is none."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("class")))


def share_url(base: str, class_name: Column) -> Column:
    """SNK-7: the URL that selects a class; the bare one where there is none."""
    return F.when(F.coalesce(class_name, F.lit("")) == "", F.lit(base)).otherwise(F.concat(F.lit(base + "?class="), F.url_encode(class_name)))


def selection_state(records: DataFrame, class_name: str, dropped: DataFrame, key: str = "id") -> DataFrame:
    """SEM-7, AGG-19: (selected, total) of a class: entering it selects all its exams, toggles take some away."""
    exams = records.filter(F.col("class_name") == class_name).select(key).distinct()
    kept = exams.join(broadcast_if_small(dropped.select(key).distinct()), key, "left_anti")
    return kept.agg(F.count(F.lit(1)).alias("selected")).join(F.broadcast(exams.agg(F.count(F.lit(1)).alias("total"))))


def cards(records: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """PRJ-13: what the cards of the records show: defaults for missing fields, the date in Chinese, whether it is selected."""
    marks = broadcast_if_small(chosen.select(F.col(key).alias("_chosen")).distinct())
    shown = records.join(marks, F.col(key) == F.col("_chosen"), "left")
    fields = [card_field(c).alias(c) for c in (*CARD_DEFAULTS, "count")]
    return shown.select(key, "row_index", *fields, display_date(F.col("start_timestamp")).alias("shown_date"), F.col("_chosen").isNotNull().alias("is_selected"))
