"""Problem 6: schemas that drift between files, by rescue-column ingestion."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import WHITESPACE
from rostra.functions.timeparse import let
from rostra.operators.ranking import numbered
from rostra.schema import ALIASES
from rostra.session import broadcast_if_small, checkpointed

#: The enforced schema: type of each standard field.
TARGET = {f: "int" if f == "count" else "string" for f in ALIASES}
_DROPPED = WHITESPACE + "﻿_＿"
#: Characters of another width and their usual forms, by rule.
_WIDTHS = {c: chr(int(d.split()[1], 16)) for c in map(chr, range(0x2000, 0x10000)) if (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>")) and c not in _DROPPED}
_KINDS = ["array", "boolean", "number", "object", "string"]
_SEP = "\x01"


def header_key(header: Column) -> Column:
    """Headers that differ only in white space, underscores, letter case or character width are the same."""
    return F.lower(F.translate(header, "".join(_WIDTHS) + _DROPPED, "".join(_WIDTHS.values())))


def _keys(headers: Column) -> Column:
    """The header key of each header: of all of them in one text, unless one of them holds the separator itself."""
    together = F.split(header_key(F.array_join(headers, _SEP)), _SEP)
    return F.when(F.size(together) == F.size(headers), together).otherwise(F.transform(headers, header_key))


def _aliases(header_alias: DataFrame) -> DataFrame:
    """(header_key, code): of each header key the standard field of the first alias; a code is a priority of ten digits, a bar and the
    field, so that codes sort as the priorities do."""
    place = F.lpad((F.coalesce(F.col("alias_pos").cast("bigint"), F.lit(-(2**31))) + 2**31).cast("string"), 10, "0")
    alias = header_alias.select(header_key(F.col("alias")).alias("header_key"), F.concat(place, F.lit("|"), "field").alias("code"))
    return alias.filter("header_key is not null and code is not null").groupBy("header_key").agg(F.min("code").alias("code"))


def _field(code: Column) -> Column:
    return F.substring(code, F.lit(12), F.length(code))


def _priority(code: Column) -> Column:
    return (F.left(code, F.lit(10)).cast("bigint") - 2**31).cast("int")


def _cells(payload: Column) -> Column:
    """Header to cell of a JSON object; null for anything else."""
    return F.from_json(payload, "map<string,variant>")


def _kind(value: Column) -> Column:
    """JSON type of a cell; null of a null cell."""
    return let(F.schema_of_variant(value), lambda shape: (
        F.when(shape == "STRING", "string").when(shape == "BIGINT", "number").when(shape == "VOID", None).when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
    ))


def _plain(kind: Column) -> Column:
    return (kind == "string") | (kind == "number")  # within a lambda cheaper than isin


def _fits(kind: str, text: Column) -> Column:
    """The text of a string or number if it fits the enforced type; null for one that must be rescued."""
    if kind in ("int", "bigint"):
        return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast(kind)).cast("string")
    return text if kind == "string" else text.try_cast(kind).cast("string")


def _resolver(sheets: DataFrame, header_alias: DataFrame, most_aliases: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The rows, and what gives the code of a header key, null for an unknown header.

    Up to `most_aliases` aliases travel as one literal: an array of small maps, addressed by the hash of the key, so that
    a lookup costs the same however many there are. Beyond that the headers of each row are joined to the aliases, and
    each row gets the map of its own; rows are told apart by a number given before, not by any column of theirs,
    and are carried through whole. Both give the same.
    """
    known = _aliases(header_alias).limit(most_aliases + 1)
    n = 1 << max(0, min(most_aliases, header_alias.limit(most_aliases + 1).count()) - 1).bit_length()
    slot = lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    found = known.select("header_key", "code", slot(F.col("header_key")).alias("slot")).collect()
    if len(found) <= most_aliases:
        slots: list[dict] = [{} for _ in range(n)]
        for r in found:
            slots[r["slot"]][r["header_key"]] = r["code"]
        table = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,string>>")
        return sheets, lambda key: table[slot(key)][key]
    rows = sheets.withColumn("_row", F.monotonically_increasing_id())
    cells = rows.withColumn("_key", F.explode_outer(F.array_distinct(_keys(F.map_keys(_cells(F.col("payload")))))))
    hits = cells.join(_aliases(header_alias), F.col("_key") == F.col("header_key"), "left").drop("header_key")
    pairs = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("_key", "code")))
    rows = hits.groupBy("_row").agg(*[F.any_value(c).alias(c) for c in sheets.columns], F.map_from_entries(pairs).alias("_alias")).drop("_row")
    return rows, lambda key: F.col("_alias")[key]


def _as_json(headers: Column, values: Column, when: Callable[[Column], Column]) -> Column:
    """A JSON object of those cells for whose index `when` holds, in their order; repeated headers stay; null where there is none."""
    one = lambda v, i: F.to_json(F.map_from_arrays(F.array(F.get(headers, i)), F.array(v)))
    bare = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    pieces = F.array_join(F.transform(values, lambda v, i: F.when(when(i), let(one(v, i), bare))), ",")  # nulls are left out
    return let(pieces, lambda t: F.when(t != "", F.concat(F.lit("{"), t, F.lit("}"))))


def _ingest(rows: DataFrame, resolve: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """`keep`, rescued, and of the cells, as arrays of one length: _h headers, _k header keys, _a codes, _t texts that fit the enforced
    type of their field, _s kinds. Arrays of plain values, since arrays of structs are copied deeply at each step."""
    rows = rows.withColumn("_m", _cells(F.col("payload")))
    rows = rows.withColumns({"_h": F.map_keys("_m"), "_v": F.map_values("_m")}).withColumns({"_k": _keys(F.col("_h")), "_s": F.transform("_v", _kind)})
    rows = rows.withColumn("_a", F.transform("_k", resolve))
    text = lambda v, i: F.when(F.get("_a", i).isNotNull() & _plain(F.get("_s", i)), F.try_variant_get(v, "$", "string"))
    fit = lambda v, i: F.when(F.get("_a", i).endswith("|count"), _fits(TARGET["count"], text(v, i))).otherwise(text(v, i))
    rows = rows.withColumn("_t", F.transform("_v", fit))
    rest = _as_json(F.col("_h"), F.col("_v"), lambda i: F.get("_t", i).isNull() & F.get("_s", i).isNotNull())
    whole = F.to_json(F.struct(F.col("payload").alias("_payload")))
    rescued = F.when(F.col("payload").isNotNull() & F.col("_m").isNull(), whole).otherwise(rest)
    return rows.select(*keep, rescued.alias("rescued"), "_h", "_k", "_a", "_t", "_s")


def _own(df: DataFrame, columns: list[str]) -> Column:
    return F.struct(F.lit(None).cast("boolean").alias(""), *[df[f"`{c}`"].alias(c) for c in columns]).alias("_own")


def rescue_rows(sheets: DataFrame, header_alias: DataFrame, most_aliases: int = 10_000) -> DataFrame:
    """One standard row for each sheet row: its own columns, every standard field in its enforced type, `rescued`: a JSON
    object of the cells that have an unknown header or don't fit, under their headers as delivered, or {"_payload": ...} where
    the payload isn't an object, and `origin`: of every cell its header, header key, field (the header itself if unknown), known,
    priority and kind (JSON type of a cell that has its place in a standard field, else null: the type of a rescued one is
    that of the rescued value). No cell that isn't null is lost: it is either in its field, in `rescued`, or another header of the
    same field with a better alias has its place. Keys of nested objects come out sorted.

    Every row, repeated ones and ones without any id included, comes out once. Payloads that aren't a JSON object
    (null, damaged, an array) give null fields and a null origin. Of a sheet's own columns those named like a standard
    field, `rescued` or `origin` give way. No shuffle with up to `most_aliases` aliases.
    """
    keep = [c for c in sheets.columns if c not in ("payload", "rescued", "origin", *TARGET)]
    # the sheet's own columns travel as one, so that no name of theirs meets one of those used here
    rows, resolve = _resolver(sheets.select(_own(sheets, keep), "payload"), header_alias, most_aliases)
    rows = _ingest(rows, resolve, ["_own"])
    # of several headers of one field the first alias that fits holds
    typed = F.array_sort(F.filter(F.arrays_zip(F.col("_a").alias("a"), F.col("_t").alias("t")), lambda c: c["t"].isNotNull()))
    rows = rows.withColumn("_f", typed).withColumns({"_f": F.transform(F.col("_f.a"), _field), "_v": F.col("_f.t")})
    value = lambda f, t: F.try_element_at("_v", F.nullif(F.array_position("_f", f), F.lit(0)).cast("int")).cast(t)
    cell = lambda h, i: F.struct(
        h.alias("header"), F.get("_k", i).alias("header_key"), F.coalesce(_field(F.get("_a", i)), h).alias("field"), F.get("_a", i).isNotNull().alias("known"),
        F.coalesce(_priority(F.get("_a", i)), F.lit(0)).alias("priority"), F.when(F.get("_t", i).isNotNull(), F.get("_s", i)).alias("kind"),
    )
    rows = rows.select("_own", *[value(f, t).alias(f) for f, t in TARGET.items()], "rescued", F.transform("_h", cell).alias("origin"))
    return rows.select(*[F.col("_own").getField(c).alias(c) for c in keep], *TARGET, "rescued", "origin")


def replay(rescued: DataFrame, promoted: dict[str, str]) -> DataFrame:
    """Promote approved fields (name to type): each becomes a column, filled from the rescue column by the first header that is
    the same but for its spelling and whose value fits the type. What was replayed leaves `rescued`; a value that doesn't
    fit stays there, and the column is null."""
    others = [c for c in rescued.columns if c not in promoted]
    rows = rescued.select(_own(rescued, others), _cells(F.col("rescued")).alias("_m")).withColumns({"_h": F.map_keys("_m"), "_v": F.map_values("_m")})
    rows = rows.withColumn("_k", _keys(F.col("_h")))
    gone, columns = F.array().cast("array<int>"), []
    for i, (name, kind) in enumerate(promoted.items()):
        plain = lambda v: F.when(_plain(_kind(v)), F.try_variant_get(v, "$", "string"))
        fits = F.transform("_v", lambda v, j: F.when(F.get("_k", j) == header_key(F.lit(name)), _fits(kind, plain(v))))  # noqa: B023
        rows = rows.withColumn(f"_p{i}", fits).withColumn(f"_at{i}", F.array_position(F.transform(f"_p{i}", lambda x: x.isNotNull()), True).cast("int"))
        columns.append(F.try_element_at(f"_p{i}", F.nullif(f"_at{i}", F.lit(0))).cast(kind).alias(name))
        gone = F.concat(gone, F.array(F.coalesce(f"_at{i}", F.lit(0))))
    left = _as_json(F.col("_h"), F.col("_v"), lambda i: ~F.array_contains("_gone", i + 1))
    rows = rows.withColumn("_gone", gone).select("_own", *columns, left.alias("_left"))
    return rows.select(*[F.col("_left").alias(c) if c == "rescued" else F.col("_own").getField(c).alias(c) for c in others], *promoted)


def schema_changes(sheets: DataFrame, header_alias: DataFrame, most_aliases: int = 10_000) -> DataFrame:
    """(source_file, field, change): each file compared with the file before it in its series, from what ingestion delivers:
    the origin of the cells in standard fields, and the rescue column, whose values are read again for the types of all others.

    added/removed: the field occurs in only one of the two; renamed: under another header key; retyped: the JSON
    type of most non-null values differs (a tie goes to the alphabetically first type; a field without any
    non-null value has no type and isn't retyped). A field the file names by several headers has the
    one of the first alias. The first file of a series has no changes. Rows without series, file number or file
    name are left out; repeated and late rows don't matter.

    The payloads are read once: all cells collapse map-side to one row per file and header. What is numbered, checkpointed and
    joined is as large as the files' headers, not as the rows.
    """
    file = ["series_id", "file_seq", "source_file"]
    named = sheets.filter("series_id is not null and file_seq is not null and source_file is not null").select(*file, "payload")
    given, resolve = _resolver(named, header_alias, most_aliases)
    rows = _ingest(given, resolve, file)
    # cells that have their place in a field, or are null; and the rescued ones, with their types read again
    placed = F.filter(F.arrays_zip(F.col("_h").alias("header"), F.col("_s").alias("kind"), F.col("_t").alias("t")), lambda c: c["t"].isNotNull() | c["kind"].isNull())
    saved = _cells(F.col("rescued"))
    again = F.arrays_zip(F.map_keys(saved).alias("header"), F.transform(F.map_values(saved), _kind).alias("kind"), F.map_keys(saved).alias("t"))
    every = F.concat(placed, F.coalesce(again, F.array().cast("array<struct<header:string,kind:string,t:string>>")))
    cells = rows.select(*file, F.inline(every)).drop("t")
    # counts by type, headers as keys: a hash aggregation, map-side as small as the files' headers
    headers = cells.groupBy(*file, "header").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in _KINDS])
    headers = headers.withColumn("header_key", header_key(F.col("header"))).join(broadcast_if_small(_aliases(header_alias)), "header_key", "left").select(
        # a field of its own is known by its header key and reported by the header as the file spells it
        *file, F.coalesce(_field(F.col("code")), F.concat(F.lit("?"), "header_key")).alias("field"), F.coalesce(_field(F.col("code")), F.col("header")).alias("name"),
        F.struct(F.coalesce("code", F.lit("")).alias("code"), "header_key").alias("h"), *_KINDS,
    )
    # files from the rows themselves: one without any cell still stands between its neighbours
    files = numbered(named.select(*file).distinct(), ["series_id"], ["file_seq", "source_file"], "file_no")
    following = files.select("series_id", (F.col("file_no") - 1).alias("file_no"), F.col("source_file").alias("next_file"))
    headers = headers.join(files.join(following, ["series_id", "file_no"], "left"), file)
    ranks = F.array(*[F.struct((-F.sum(k)).alias("n"), F.lit(k).alias("kind")) for k in _KINDS])
    fields = headers.groupBy("series_id", "file_no", "field").agg(
        F.array_min(F.filter(ranks, lambda x: x["n"] < 0))["kind"].alias("kind"), F.min("h")["header_key"].alias("header"), F.min("name").alias("name"),
        F.min("source_file").alias("source_file"), F.min("next_file").alias("next_file"),
    )
    now = checkpointed(fields).withColumn("is_now", F.lit(True))
    before = now.filter("next_file is not null").select(
        "series_id", (F.col("file_no") + 1).alias("file_no"), "field", F.col("name").alias("p_name"), F.col("kind").alias("p_kind"),
        F.col("header").alias("p_header"), "next_file", F.lit(True).alias("was"),
    )
    both = now.drop("next_file").join(before, ["series_id", "file_no", "field"], "full").filter("file_no > 1")
    was, is_ = F.col("was").isNotNull(), F.col("is_now").isNotNull()
    changes = F.array(
        F.when(~was, "added"), F.when(~is_, "removed"),
        F.when(was & is_ & (F.col("header") != F.col("p_header")), "renamed"),
        F.when(was & is_ & (F.col("kind") != F.col("p_kind")), "retyped"),
    )
    return both.select(
        F.coalesce("source_file", "next_file").alias("source_file"), F.coalesce("name", "p_name").alias("field"), F.explode(F.array_compact(changes)).alias("change")
    ).distinct()
