"""FLT-1..5, JOIN-4/7, LIM-4, PRJ-15..17, SET-5: which notice, which attachments, and whether they changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.schema import EXCLUDE_WORDS, REQUIRED_WORDS, STUDENT_WORDS, TARGET_WORDS, TEACHER_WORDS


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def is_schedule_title(title: Column) -> Column:
    """FLT-1: none of the excluding words, all required ones, at least one of the target words."""
    required = F.forall(F.array(*map(F.lit, REQUIRED_WORDS)), lambda w: F.contains(title, w))
    return F.coalesce(~_any(title, EXCLUDE_WORDS) & required & _any(title, TARGET_WORDS), F.lit(False))


def is_student_file(name: Column) -> Column:
    return _any(name, STUDENT_WORDS)


def is_teacher_file(name: Column) -> Column:
    return _any(name, TEACHER_WORDS)


def newest_notice(notices: DataFrame, position: str = "pos") -> DataFrame:
    """LIM-4: the first valid notice in page order; no row if there is none."""
    return notices.filter(is_schedule_title(F.col("title"))).orderBy(position).limit(1)


def chosen_attachments(files: DataFrame, page: str, name: str = "name") -> DataFrame:
    """FLT-5, WIN-4: of pages with a file for students only those files, of other pages all but the teachers'.

    The flag is aggregated per page with map-side combine and joined back, rather than computed in a window, which
    would bring all files of a page into one task."""
    flags = files.groupBy(page).agg(F.max(is_student_file(F.col(name))).alias("_any"))
    keep = F.when(F.col("_any"), is_student_file(F.col(name))).otherwise(~is_teacher_file(F.col(name)))
    return files.join(flags, page).filter(keep).drop("_any")


def absolute_url(base: str, href: Column) -> Column:
    """PRJ-15: a reference of any form against the page it stands on, as RFC 3986 resolves it: absolute ones and //host stay as they
    are, ?query and #fragment keep the page's path, and dot segments anywhere in a path are resolved, as often as they
    occur and never above the root. Null gives null, an empty reference the page itself."""
    scheme, _, rest = base.partition("://")
    host = re.match("[^/?#]*", rest)[0]
    path, query = re.match("([^?#]*)([?][^#]*)?", rest[len(host) :]).groups("")
    site, folder = f"{scheme}://{host}", path[: path.rfind("/") + 1] or "/"
    own = F.regexp_extract(href, "^[^?#]*", 0)
    tail = F.substring(href, F.length(own) + 1, F.length(href))
    segments = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(F.lit(folder), own)), "/")
    last = F.element_at(segments, -1)
    # empty segments within a relative path vanish; a closing dot segment leaves the folder
    inner = F.filter(segments, lambda s, i: (i == 0) | (s != "") | (i == F.size(segments) - 1) | own.startswith("/"))
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(inner, F.array().cast("array<string>"), step)
    whole = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    whole = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))
    return (
        F.when(href == "", F.lit(base)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{scheme}:"), href))
        .when(href.startswith("#"), F.concat(F.lit(site + path + query), href)).when(href.startswith("?"), F.concat(F.lit(site + path), href))
        .otherwise(F.concat(F.lit(site), whole, tail))
    )


def is_workbook_link(href: Column) -> Column:
    """FLT-4: the lower-case reference ends in .xls or .xlsx; a query string defeats it."""
    return F.coalesce(F.lower(href).rlike(r"\.xlsx?$"), F.lit(False))


def attachment_name(text: Column, href: Column) -> Column:
    """PRJ-16: the link text if it is a file name, else the last part of the reference, without illegal characters."""
    name = F.when(F.lower(text).rlike(r"\.xlsx?$"), text).otherwise(F.substring_index(href, "/", -1))
    return F.regexp_replace(name, r'[\\/*?:"<>|]', "")


def notice_title(attribute: Column, text: Column) -> Column:
    """PRJ-17."""
    return F.coalesce(F.nullif(attribute, F.lit("")), F.trim(text))


def file_changes(old: DataFrame, new: DataFrame, name: str = "name", digest: str = "digest") -> DataFrame:
    """JOIN-4, SEM-10: (name, status) of the union of both file sets: added, removed, changed or same."""
    a = old.select(F.col(name), F.col(digest).alias("_old"), F.lit(1).alias("_in_old"))
    b = new.select(F.col(name), F.col(digest).alias("_new"), F.lit(1).alias("_in_new"))
    status = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    )
    return a.join(b, name, "full").select(name, status.alias("status"))


def rows_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-6 without order: (equal): whether both hold the same rows equally often.

    Rows are counted with their sign by a 128-bit hash of all columns: one aggregation, no set difference twice."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        h = [F.xxhash64(*df.columns), F.xxhash64(F.lit("2"), *df.columns)]
        return df.select(h[0].alias("_a"), h[1].alias("_b"), F.lit(sign).alias("_s"))

    if a.columns != b.columns:
        return a.sparkSession.range(1).select(F.lit(False).alias("equal"))
    rest = signed(a, 1).unionAll(signed(b, -1)).groupBy("_a", "_b").agg(F.sum("_s").alias("_s")).filter("_s <> 0")
    return rest.agg((F.count(F.lit(1)) == 0).alias("equal"))


def unchanged(a: DataFrame, b: DataFrame, order: list[str], strict: bool = True) -> bool:
    """SET-6: strict equality also compares the order, which `order` spells out by columns of both sides; else the
    rows as a multiset. The strict form hashes each row with its ordinal columns."""
    drop = [] if strict else order
    return bool(rows_differ(a.drop(*drop), b.drop(*drop)).first()["equal"])


def first_row_per(df: DataFrame, keys: list[str], order: list[str], top: int, name: str | None = None) -> DataFrame:
    """LIM-1: the first rows of each file, with their place as `name` if one is given. The row limit is applied map-side, before
    the window's shuffle."""
    ranked = df.withColumn(name or "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name or "_r") <= top)
    return ranked if name else ranked.drop("_r")


def fetch_summary(fetched: DataFrame, ok: str = "ok") -> DataFrame:
    """AGG-20: (fetched, failed, any): how many downloads came through; null counts as failed."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return fetched.agg(F.count_if(good).alias("fetched"), F.count_if(~good).alias("failed"), F.coalesce(F.max(good), F.lit(False)).alias("any"))
