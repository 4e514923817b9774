"""Pieces of checking SQL (DuckDB) shared by the queries."""

from __future__ import annotations

from rostra.schema import IMPOSSIBLE_TIME, MISSING_TIME, UNRECOGNIZED_TIME

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"
WIDE_DIGITS = "０１２３４５６７８９"
D = "[0-9０-９]"
_CLOCK = f"{D}{{1,2}}:{D}{{2}}"
_RANGE = rf".*?({_CLOCK}){SPACE}*[-~至]{SPACE}*({_CLOCK})"
_CN = f"({D}{{4}})年({D}{{1,2}})月({D}{{1,2}})日{_RANGE}"
_ISO = rf"\(?({D}{{4}})-({D}{{1,2}})-({D}{{1,2}})\)?{_RANGE}"
_HOUR = f"^(2[0-3]|[01]{D}|{D}):[0-5]{D}$"


def narrow(c: str) -> str:
    return f"translate({c}, '{WIDE_DIGITS}', '0123456789')"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def clean(c: str) -> str:
    return strip(f"replace(coalesce({c}, ''), chr(160), ' ')")


def parsed(source: str) -> str:
    """CTEs up to `parsed`: the rows of `source`, whose column t is the cleaned time text, with error, ok, day, sm, em."""
    minutes = lambda c: f"cast({narrow(f'split_part({c}, chr(58), 1)')} as int) * 60 + cast({narrow(f'split_part({c}, chr(58), 2)')} as int)"
    return f"""
with p0 as ({source}),
p1 as (select *, regexp_extract(t, '{_CN}', ['y','m','d','s','e']) cn, regexp_extract(t, '{_ISO}', ['y','m','d','s','e']) iso from p0),
p2 as (select *, case when cn.y <> '' then cn else iso end as g from p1),
p3 as (select *, try_cast({narrow("g.y")} || '-' || {narrow("g.m")} || '-' || {narrow("g.d")} as date) as d0 from p2),
p4 as (select *, d0 is not null and {narrow("g.y")} <> '0000' and regexp_matches(g.s, '{_HOUR}') and regexp_matches(g.e, '{_HOUR}')
         and (cn.y <> '' or regexp_matches(iso.m, '^[0-9]+$') and regexp_matches(iso.d, '^[0-9]')) ok from p3),
parsed as (select * exclude (cn, iso, g, d0), case when t = '' then '{MISSING_TIME}' when g.y = '' then '{UNRECOGNIZED_TIME}' when not ok then '{IMPOSSIBLE_TIME}' end error,
         case when ok then d0 end as day, case when ok then {minutes("g.s")} end sm, case when ok then {minutes("g.e")} end em from p4)
"""


def wire(minutes: str) -> str:
    return f"strftime(cast(day as timestamp) + to_minutes({minutes}), '%Y-%m-%dT%H:%M:%S+08:00')"
