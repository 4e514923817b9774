"""Problem 2: rows that fail to parse, by a minimum-cost error parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.functions.text import WIDE_DIGITS, coerce_count, clean_text, strip
from rostra.functions.timeparse import beijing_text, parse_time_range
from rostra.schema import IMPOSSIBLE_TIME, MISSING_TIME, UNRECOGNIZED_TIME

#: Columns of the exported text files, as standard fields.
RAW_COLUMNS = ["campus", "school", "course_code", "course_name", "class_name", "teacher", "count", "raw_time", "location"]

_START, _PLAIN, _QUOTED, _CLOSED = range(4)


def shape_of(line: Column) -> Column:
    """What decides the parse of a line: its quotes and commas, each run of other characters as one t.
    One carriage return at the end isn't part of the line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), r"\r\z", ""), '[^",]+', "t")


def minimum_cost_parse(shape: str, columns: int) -> tuple[int, int, str]:
    """(quote edits, delimiter edits, operations) of the cheapest way to read a shape as `columns` fields.

    Dynamic programming over the tokens; a state is (field number, mode). Quotes may be inserted or deleted
    where the strict grammar has no way on; delimiters may be deleted (the next field is joined to this one) or
    inserted at the end. A quote edit outweighs any number of delimiter edits, so a line has quote edits in its
    cheapest parse exactly if its quoting is broken, and otherwise its delimiter edits are the columns that
    are too many or too few. Zero cost: the strict grammar accepts the line.
    """
    quote = len(shape) + columns + 1  # outweighs all delimiter edits together
    states: dict[tuple[int, int], tuple[int, tuple | None]] = {(1, _START): (0, None)}
    for at, token in enumerate(shape):
        after: dict[tuple[int, int], tuple[int, tuple | None]] = {}

        def go(field: int, mode: int, cost: int, ops: tuple | None) -> None:
            old = after.get((field, mode))
            if old is None or cost < old[0]:
                after[field, mode] = (cost, ops)

        for (field, mode), (cost, ops) in states.items():
            if token == "t":
                if mode == _CLOSED:  # text after a closing quote: that quote was one of the text
                    go(field, _QUOTED, cost + quote, (ops, "insert_quote", at))
                else:
                    go(field, _PLAIN if mode == _START else mode, cost, ops)
                    if mode == _START:
                        go(field, _QUOTED, cost + quote, (ops, "insert_quote", at))
            elif token == '"':
                if mode == _START:
                    go(field, _QUOTED, cost, ops)
                elif mode == _QUOTED:
                    go(field, _CLOSED, cost, ops)
                elif mode == _CLOSED:
                    go(field, _QUOTED, cost, ops)
                if mode != _CLOSED:
                    go(field, _PLAIN if mode == _START else mode, cost + quote, (ops, "delete_quote", at))
            elif mode == _QUOTED:
                go(field, _QUOTED, cost, ops)
                if field < columns:
                    go(field + 1, _START, cost + quote, (ops, "insert_quote", at))
            else:
                if field < columns:
                    go(field + 1, _START, cost, ops)
                go(field, _START, cost + 1, (ops, "delete_delimiter", at))
        states = after
    best, chain, missing = None, None, 0
    for (field, mode), (cost, ops) in states.items():
        if mode == _QUOTED:
            cost, ops = cost + quote, (ops, "insert_quote", len(shape))
        if best is None or cost + columns - field < best:
            best, chain, missing = cost + columns - field, ops, columns - field
    named: dict[str, int] = {"insert_delimiter": missing} if missing else {}
    while chain:
        chain, op, _ = chain
        named[op] = named.get(op, 0) + 1
    return best // quote, best % quote, ",".join(f"{op}:{n}" for op, n in sorted(named.items()))


_EDITS = T.StructType([
    T.StructField("quote_edits", T.IntegerType()), T.StructField("delimiter_edits", T.IntegerType()), T.StructField("operations", T.StringType()),
])


def _cheapest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[str, int], tuple[int, int, str]] = {}  # few shapes make up almost all lines
    for shapes, columns in batches:
        rows = []
        for key in zip(shapes, columns, strict=True):
            cost = known.get(key)
            if cost is None:
                cost = minimum_cost_parse(*key)
                if len(key[0]) < 200 and len(known) < 200_000:
                    known[key] = cost
            rows.append(cost)
        yield pd.DataFrame(rows, columns=["quote_edits", "delimiter_edits", "operations"])


def split_fields(line: Column) -> Column:
    """The values of a line of zero cost. Possessive repeats: no back-tracking and no deep recursion."""
    body = F.concat(F.lit(","), F.regexp_replace(F.coalesce(line, F.lit("")), r"\r\z", ""))
    cells = F.regexp_extract_all(body, F.lit(r',((?:"[^"]*+")++|[^",]*+)'), F.lit(1))
    unquoted = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda x: F.when(x.startswith('"'), unquoted(x)).otherwise(x))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds to each row the fields of RAW_COLUMNS as strings (null where the row isn't of zero cost), `operations`
    (the edits of the cheapest parse with their numbers), `quote_edits` and `delimiter_edits` (how many), the parsed time and `reason`
    (null: valid), which the operations state, or the types of the values where there are none.

    Reasons in this order: broken_quoting, column_count, bad_count, missing_time, unrecognized_time,
    impossible_time. A null line reads as an empty one (column_count); a blank count is allowed. All columns
    of the input stay, except that those of the names added here are replaced.
    """
    # non-deterministic by declaration: else a filter on the reason would be pushed below and the parse run twice
    cost = F.pandas_udf(_cheapest, _EDITS).asNondeterministic()(shape_of(F.col(line)), F.lit(len(RAW_COLUMNS)))
    out = lines.withColumn("_cost", cost)
    edits = F.col("_cost.operations")
    out = out.withColumn("_fields", F.when(edits == "", split_fields(F.col(line))))
    out = out.withColumn("_time", parse_time_range(clean_text(F.try_element_at("_fields", F.lit(8)))))
    count = strip(F.try_element_at("_fields", F.lit(7)))
    reason = (
        F.when(edits.contains("quote"), "broken_quoting").when(edits.contains("delimiter"), "column_count")
        .when(~F.coalesce(count, F.lit("")).rlike(f"^[0-9{WIDE_DIGITS}]*$"), "bad_count")
        .when(F.col("_time.error") == MISSING_TIME, "missing_time")
        .when(F.col("_time.error") == UNRECOGNIZED_TIME, "unrecognized_time")
        .when(F.col("_time.error") == IMPOSSIBLE_TIME, "impossible_time")
    )
    added = {name: F.try_element_at("_fields", F.lit(i + 1)) for i, name in enumerate(RAW_COLUMNS)}
    return out.withColumns(added | {"quote_edits": F.col("_cost.quote_edits"), "delimiter_edits": F.col("_cost.delimiter_edits"), "operations": edits, "reason": reason})


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines below a header that aren't valid."""
    parsed = parse_lines(lines.filter("line_no > 1").select("line_id", "line"))
    # a generator, not a filter, which would be pushed below and repeat the checks
    return parsed.select("line_id", F.explode(F.when(F.col("reason").isNotNull(), F.array("reason"))).alias("reason")).distinct()


def line_edits(lines: DataFrame) -> DataFrame:
    """(line_id, quote_edits, delimiter_edits, operations) of every line below a header: what would have to be done for it to parse.
    A delimiter that is missing could stand anywhere; it is counted at the end, at the same cost."""
    parsed = parse_lines(lines.filter("line_no > 1").select("line_id", "line"))
    return parsed.select("line_id", "quote_edits", "delimiter_edits", "operations")


def loaded_lines(lines: DataFrame) -> DataFrame:
    """The valid lines below a header as records: cleaned text, integer count, parsed times."""
    parsed = parse_lines(lines.filter("line_no > 1").select("line_id", "file_name", "line_no", "line"))
    text = {c: clean_text(F.col(c)) for c in RAW_COLUMNS if c != "count"} | {"count": coerce_count(F.col("count"))}
    record = F.struct(
        "line_id", "file_name", "line_no", *[text[c].alias(c) for c in RAW_COLUMNS],
        beijing_text(F.col("_time.start_s")).alias("start_timestamp"), beijing_text(F.col("_time.end_s")).alias("end_timestamp"),
        F.col("_time.minutes").alias("duration_minutes"), F.col("_time.date").alias("date"),
    )
    return parsed.select(F.inline(F.when(F.col("reason").isNull(), F.array(record))))
