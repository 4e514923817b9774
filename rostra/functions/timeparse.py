"""PRJ-8: a free-form date with a time range becomes start, end, minutes, date or an error class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostra.functions.civil import clock_text, days_from_date, valid_date
from rostra.functions.text import WIDE_DIGITS
from rostra.schema import IMPOSSIBLE_TIME, MISSING_TIME, UNRECOGNIZED_TIME

_SEP = "\x01"
# The two notations, Unicode digits and white space, "." stops at \n only.
_RANGE = r".*?(\d{1,2}:\d{2})[\s\x1c-\x1f]*[-~至][\s\x1c-\x1f]*(\d{1,2}:\d{2})"
CHINESE = r"(\d{4})年(\d{1,2})月(\d{1,2})日" + _RANGE
ISO = r"\(?(\d{4})-(\d{1,2})-(\d{1,2})\)?" + _RANGE


def _parts(c: Column, pattern: str) -> Column:
    """All five groups of the leftmost match in one pass of the regex engine; null where none matches."""
    out = F.regexp_replace(c, rf"(?U)(?d)^[\s\S]*?{pattern}[\s\S]*$", _SEP + _SEP.join(f"${i}" for i in range(1, 6)))
    return let(out, lambda x: F.when(x.startswith(_SEP), F.split(x, _SEP)))


def parse_time_range(raw: Column) -> Column:
    """struct(start_s, end_s, minutes, date, error) of a cleaned text.

    start_s and end_s are wall-clock seconds at +08:00, all fields are null unless both ends are possible
    (all or nothing); `minutes` is negative where the end is the earlier one. Null and empty texts give the
    missing error, texts in neither notation the unrecognized one, impossible dates or clock times the third.
    """
    return let(raw, _parse)


def _parse(raw: Column) -> Column:
    cn, iso = _parts(raw, CHINESE), _parts(raw, ISO)
    found = F.coalesce(F.concat(F.array(F.lit("cn")), cn), F.concat(F.array(F.lit("iso")), iso))
    numbers = let(found, _numbers)

    def result(v: Column) -> Column:
        ok = F.coalesce(v["readable"] & valid_date(v["y"], v["m"], v["d"]) & v["s"].isNotNull() & v["e"].isNotNull(), F.lit(False))
        day = days_from_date(v["y"], v["m"], v["d"]) * 86400
        start, end = F.when(ok, day + v["s"] * 60), F.when(ok, day + v["e"] * 60)
        return F.struct(
            start.alias("start_s"),
            end.alias("end_s"),
            F.when(ok, v["e"] - v["s"]).cast("int").alias("minutes"),
            F.when(ok, F.date_from_unix_date((day / 86400).cast("int")).cast("string")).alias("date"),
            F.when(F.coalesce(v["raw"], F.lit("")) == "", MISSING_TIME)
            .when(v["readable"].isNull(), UNRECOGNIZED_TIME)
            .when(~ok, IMPOSSIBLE_TIME)
            .alias("error"),
        )

    return let(F.struct(raw.alias("raw"), numbers.alias("n")), lambda x: let(F.struct(x["raw"], *(x["n"][k].alias(k) for k in ("readable", *"ymdse"))), result))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: common subexpressions in branches aren't shared otherwise."""
    return F.transform(F.array(value), body)[0]


def compiled_apart(value: Column) -> Column:
    """The value itself. A projection that holds a lambda isn't fused with its neighbours into one generated method but is
    compiled by itself, in many small ones. For projections of long expressions, whose fused method would pass 8,000
    bytes of bytecode, beyond which the JVM's compiler leaves a method to the interpreter."""
    return let(value, lambda x: x)


def _numbers(p: Column) -> Column:
    """Components as integers; p is [notation, '', y, m, d, start, end]."""
    digits = lambda c: F.translate(c, WIDE_DIGITS, "0123456789").try_cast("int")
    # in the ISO notation month and day must start with an ASCII digit to be read
    readable = (p[0] == "cn") | (p[3].rlike("^[0-9]+$") & p[4].rlike("^[0-9]"))

    def clock(c: Column) -> Column:
        part = lambda i: digits(F.split_part(c, F.lit(":"), F.lit(i))).cast("bigint")
        return F.when(c.rlike(r"^(?U)(2[0-3]|[01]\d|\d):[0-5]\d$"), part(1) * 60 + part(2))

    columns = {"readable": readable, "y": digits(p[2]), "m": digits(p[3]), "d": digits(p[4]), "s": clock(p[5]), "e": clock(p[6])}
    return F.struct(*(v.alias(k) for k, v in columns.items()))


def beijing_text(seconds: Column) -> Column:
    """Wire form of wall-clock seconds at +08:00."""
    return F.concat(clock_text(seconds), F.lit("+08:00"))
