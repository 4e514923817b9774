"""Problem 5: mixed timestamp formats and time zones, normalised to instants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.civil import clock_text, days_from_date, floor_div, valid_date
from rostra.functions.text import WHITESPACE
from rostra.functions.timeparse import compiled_apart
from rostra.session import broadcast_if_small

_SEP = "\x01"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]{0,6}"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]{0,6},?\s+)?"
_NAMED_ZONE = r"[a-z]+(?:/[a-z0-9_+\-]+)+"
#: A zone behind a time: an offset, a name, Beijing time, UTC; the name in brackets behind an offset is ignored.
_ZONE = (
    rf"(?:\s*[(（]?(?:(?<z{{0}}>z|北京时间|{_NAMED_ZONE})|(?:utc|gmt)?(?<zs{{0}}>[+-])(?<zh{{0}}>\d{{{{1,2}}}})(?::?(?<zm{{0}}>\d{{{{2}}}}))?|(?<zu{{0}}>utc|gmt))[)）]?"
    rf"(?:\[{_NAMED_ZONE}\])?)?"
)
_CLOCK = r"(?<h{0}>\d{{1,2}})[:：](?<n{0}>\d{{2}})(?:[:：](?<s{0}>\d{{2}})(?:[.,]\d{{1,9}})?)?"

#: Every notation of a single stamp; each alternative has its own named groups.
_STAMPS = [
    r"(?<ya>\d{4})(?<sep>[-/.])(?<ma>\d{1,2})\k<sep>(?<da>\d{1,2})(?:t|\s+)" + _CLOCK.format("a"),
    r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})t?(?<hb>\d{2})(?<nb>\d{2})(?<sb>\d{2})(?:[.,]\d{1,9})?",
    r"(?<yc>\d{4})年(?<mc>\d{1,2})月(?<dc>\d{1,2})日\s*(?<pc>上午|下午|凌晨|早上|晚上|中午)?\s*" + _CLOCK.format("c"),
    _DAY + rf"(?<dd>\d{{1,2}})\s+(?<md>{_MONTH})\.?\s+(?<yd>\d{{4}}),?\s+" + _CLOCK.format("d"),
    rf"{_DAY}(?<me>{_MONTH})\.?\s+(?<de>\d{{1,2}}),?\s+(?<ye>\d{{4}}),?\s+" + _CLOCK.format("e") + r"\s*(?<pe>am|pm)?",
]
#: A date with a time range, and the zone behind it.
_RANGE = (
    r".*?(?:(?<yf>\d{4})年(?<mf>\d{1,2})月(?<df>\d{1,2})日|(?<yg>\d{4})-(?<mg>\d{1,2})-(?<dg>\d{1,2})).*?"
    r"(?<hf>\d{1,2}):(?<nf>\d{2})\s*[-~至]\s*(?<hi>\d{1,2}):(?<ni>\d{2})\)?" + _ZONE.format("f") + r"[^a-z+]*"
)
#: What marks a text that stands for both ends: "8:00-9:00" ends a range there, and in a single stamp is a time with an offset.
_BOTH = "\x02"
#: All notations in one alternation.
_ANY = rf"(?i)^[{WHITESPACE}]*(?:{_BOTH}{_RANGE}|(?:(?<es>\d{{10}})|(?<em>\d{{13}})|(?:{'|'.join(_STAMPS)}){_ZONE.format('a')})[{WHITESPACE}]*)$"
#: Of each component the groups that may hold it; only those of the alternative that matched are filled.
_PARTS = {
    "y": "ya yb yc yd ye yf yg", "m": "ma mb mc mf mg", "month": "md me", "d": "da db dc dd de df dg", "h": "ha hb hc hd he hf", "n": "na nb nc nd ne nf", "s": "sa sb sc sd se",
    "half": "pc pe", "zone": "za zf", "sign": "zsa zsf", "zh": "zha zhf", "zm": "zma zmf", "utc": "zua zuf", "es": "es", "em": "em", "h2": "hi", "n2": "ni",
}
#: The replacement refers to the groups by their numbers, which spares a look-up of each name for each text.
_NUMBERS = {name: i for i, name in enumerate(re.findall(r"\(\?<(\w+)>", _ANY), 1)}
_OUT = "".join(_SEP + "".join(f"${_NUMBERS[g]}" for g in groups.split()) for groups in _PARTS.values())


def _extract(text: Column) -> Column:
    """All components in one pass: the whole text is replaced by the groups. Where nothing matches one piece is left."""
    return F.split(F.regexp_replace(F.when(~F.contains(text, F.lit(_SEP)), text), _ANY, _OUT), _SEP)


def known_zones(df: DataFrame) -> list[str]:
    """Zone ids the JVM knows (some hundred, whatever the data)."""
    jvm = df.sparkSession._jvm
    return [z for z in jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",") if "/" in z]


def _components(p: dict[str, Column]) -> dict[str, Column]:
    """Typed components of the extracted texts; the month by number or by name, the offset in minutes up to 18 hours."""
    number = lambda k, kind="int": F.when(p[k] != "", p[k].cast(kind))
    month = F.array_position(F.array(*[F.lit(x) for x in _MONTHS]), F.lower(F.left(p["month"], F.lit(3)))).cast("int")
    minutes = F.coalesce(number("zm"), F.lit(0))
    named = F.lower(p["zone"])
    offset = (
        F.when((p["utc"] != "") | (named == "z"), 0).when(named == "北京时间", 8 * 60)
        .when((p["sign"] != "") & (number("zh") <= 18) & (minutes < 60), F.when(p["sign"] == "-", -1).otherwise(1) * (number("zh") * 60 + minutes))
    )
    return {
        "y": number("y"), "m": F.when(p["month"] != "", month).otherwise(number("m")), "d": number("d"), "h": _hour(number("h"), F.lower(p["half"])), "n": number("n"),
        "s": F.coalesce(number("s"), F.lit(0)), "offset": offset, "zone": F.when(p["sign"] == "", p["zone"]),
        "epoch": F.coalesce(number("es", "bigint"), floor_div(number("em", "bigint"), 1000)),
    }


def _hour(h: Column, half: Column) -> Column:
    return (
        F.when(half == "", h)
        .when(half.isin("am", "pm") & ~h.between(1, 12), F.lit(None).cast("int"))
        .when(half == "am", h % 12)
        .when(half == "pm", h % 12 + 12)
        .when(half.isin("上午", "凌晨", "早上"), F.when(h <= 12, h % 12))
        .when((half == "中午") & (h >= 11), h)
        .otherwise(F.when(h < 12, h + 12).otherwise(h))
    )


def _wall_seconds(y: Column, m: Column, d: Column, h: Column, n: Column, s: Column) -> Column:
    ok = valid_date(y, m, d) & h.between(0, 23) & n.between(0, 59) & s.between(0, 59)
    return F.when(ok, days_from_date(y, m, d) * 86400 + (h * 3600 + n * 60 + s).cast("bigint"))


def _by_zone(wall: Column, zone: Column) -> Column:
    """A local time that occurs twice is its earlier instant; one that is skipped moves later by the gap."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), zone))


def normalise_times(feed: DataFrame, campus_zone: DataFrame) -> DataFrame:
    """Adds start_utc and end_utc (UTC, whole seconds, null if not both can be determined) to the rows of the feed.

    If start_timestamp or end_timestamp holds more than white space, both ends come from these two, else from
    raw_time. Values without a zone are in the zone of the row's campus; a null or unknown campus has none.
    campus_zone is a dimension (one row per campus); its size is checked before it is broadcast. If a campus has
    several zones there, the alphabetically first one holds. Nulls, empty texts and impossible dates or
    clock times give null.
    """
    home = campus_zone.groupBy("campus").agg(F.min("zone_id").alias("_home"))
    rows = feed.join(broadcast_if_small(home), "campus", "left")
    zones = known_zones(feed)
    start, end, raw = F.col("start_timestamp"), F.col("end_timestamp"), F.col("raw_time")
    shown = lambda c: F.coalesce(c.rlike(f"[^{WHITESPACE}]"), F.lit(False))
    # step by step: each projection refers to columns of the one before, so nothing is computed twice
    rows = rows.withColumn("_filled", shown(start) | shown(end))
    filled = F.col("_filled")
    rows = rows.withColumns({"_lo": _extract(F.when(filled, start).otherwise(F.concat(F.lit(_BOTH), raw))), "_hi": _extract(F.when(filled, end))})
    place = {k: i for i, k in enumerate(_PARTS, 1)}
    low = lambda k: F.get("_lo", F.lit(place[k]))
    high = lambda k: F.when(filled, F.get("_hi", F.lit(place[k]))).otherwise(low({"h": "h2", "n": "n2"}.get(k, k)))
    sides = {"lo": {k: low(k) for k in _PARTS}, "hi": {k: high(k) for k in _PARTS}}
    of = lambda e: lambda name: F.col(f"_{e}_{name}")
    parts = {f"_{e}_{k}": v for e, p in sides.items() for k, v in _components(p).items()}
    rows = rows.withColumns(parts | {"_home": compiled_apart(F.col("_home"))})
    wall = lambda c: _wall_seconds(*(c(k) for k in "ymdhns"))
    rows = rows.withColumns({
        **{f"_{e}_wall": wall(of(e)) for e in ("lo", "hi")},
        **{f"_{e}_named": F.when(of(e)("zone") == "", compiled_apart(F.col("_home"))).otherwise(of(e)("zone")) for e in ("lo", "hi")},
    })
    # one parsed expression, not a literal object for each of some hundred names
    listed = ", ".join(f"'{z}'" for z in zones)
    known = lambda e: F.expr(f"case when _{e}_named in ({listed}) then _{e}_named end")
    utc = lambda e: F.coalesce(compiled_apart(of(e)("epoch")), of(e)("wall") - of(e)("offset") * 60, _by_zone(of(e)("wall"), known(e)))
    rows = rows.withColumns({"_low": utc("lo"), "_high": utc("hi")})
    both = compiled_apart(F.col("_low").isNotNull() & F.col("_high").isNotNull())
    text = lambda c: F.when(both, F.concat(clock_text(F.col(c)), F.lit("Z")))
    return rows.withColumns({"start_utc": text("_low"), "end_utc": text("_high")}).select(*feed.columns, "start_utc", "end_utc")


def found_times(feed: DataFrame, campus_zone: DataFrame) -> DataFrame:
    """(feed_id, start_utc, end_utc) of the rows whose two instants can be determined."""
    needed = feed.select("feed_id", "campus", "raw_time", "start_timestamp", "end_timestamp")
    done = normalise_times(needed, campus_zone)
    # not a filter: it would be pushed below the projections and repeat all of their work in one expression
    found = F.when(F.col("start_utc").isNotNull(), F.array(F.struct("start_utc", "end_utc")))
    return done.select("feed_id", F.inline(found)).distinct()
