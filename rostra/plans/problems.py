"""Queries of the general data problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.operators import badrows, drift, intervals, packed, snapshots, timestamps
from rostra.plans import sql
from rostra.schema import MISSING_TIME, UNRECOGNIZED_TIME
from rostra.session import table


def p1_found(spark, d):
    t = table(spark, d, "exam_snapshot")
    return snapshots.snapshot_changes(t, snapshots.exam_state(t))


def p2_found(spark, d):
    return badrows.rejected_lines(table(spark, d, "exam_raw_line"))


def p2_loaded(spark, d):
    return badrows.loaded_lines(table(spark, d, "exam_raw_line"))


def p2_edits(spark, d):
    """The operations of every line; of one with broken quoting only that it needs quote edits, which is what SQL can tell."""
    edits = badrows.line_edits(table(spark, d, "exam_raw_line"))
    quotes = F.col("quote_edits") > 0
    return edits.select("line_id", quotes.alias("quoting"), F.when(~quotes, F.col("operations")).alias("operations"))


def p3_found(spark, d):
    return intervals.class_periods(table(spark, d, "exam_record"))


def p4_found(spark, d):
    return packed.unpack_values(table(spark, d, "exam_record"), "teacher", ["id"], at_least=2)


def p5_found(spark, d):
    return timestamps.found_times(table(spark, d, "exam_time_feed"), table(spark, d, "campus_zone"))


def p6_found(spark, d):
    return drift.schema_changes(table(spark, d, "exam_sheet_row"), table(spark, d, "header_alias"))


def p6_standard(spark, d):
    """The one consistent table, with the approved fields promoted out of the rescue column."""
    rows = drift.rescue_rows(table(spark, d, "exam_sheet_row"), table(spark, d, "header_alias"))
    return drift.replay(rows.drop("origin"), {"座位数": "int", "场次": "string"})


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_loaded, p2_edits, p3_found, p4_found, p5_found, p6_found, p6_standard)}

_CELL = '"(?:[^"]|"")*"|[^",]*'


_P1 = f"""
with r as (
  select snapshot_no, id, epoch_us(cast(start_timestamp as timestamptz)) st, coalesce({sql.strip("replace(location, chr(160), ' ')")}, '') loc,
         row_number() over (partition by snapshot_no, id order by ingested_at desc) k
  from exam_snapshot where id is not null and snapshot_no is not null),
l as (select * exclude k from r where k = 1),
n as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) nxt from (select distinct snapshot_no from l)),
a as (select n.nxt snapshot_no, id, st, loc from l join n using (snapshot_no) where nxt is not null),
b as (select * from l where snapshot_no > (select min(snapshot_no) from l))
select coalesce(a.snapshot_no, b.snapshot_no) snapshot_no, coalesce(a.id, b.id) id,
       case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change
from a full join b on a.snapshot_no = b.snapshot_no and a.id = b.id
where a.id is null or b.id is null or a.st is distinct from b.st or a.loc <> b.loc
"""

_BARE = lambda k: f"case when f[{k}] like '\"%' then replace(f[{k}][2:-2], '\"\"', '\"') else f[{k}] end"
_P2_PARSED = sql.parsed(f"""
  select *, {sql.strip(_BARE(7))} n, {sql.clean(_BARE(8))} t from (
    select *, regexp_full_match(line, '(?:{_CELL})(?:,(?:{_CELL}))*') quoted, regexp_extract_all(',' || line, ',({_CELL})', 1) f from (
      select line_id, file_name, line_no, regexp_replace(coalesce(line, ''), '\\r$', '') line from exam_raw_line where line_no > 1))""") + f""",
w as (select *, case when not quoted then 'broken_quoting' when len(f) <> 9 then 'column_count' when not regexp_matches(n, '^{sql.D}*$') then 'bad_count'
        when error = '{MISSING_TIME}' then 'missing_time' when error = '{UNRECOGNIZED_TIME}' then 'unrecognized_time'
        when error is not null then 'impossible_time' end reason from parsed)
"""
_P2_LOADED = _P2_PARSED + f"""
select line_id, file_name, line_no, {", ".join(f'{sql.clean(_BARE(i + 1))} "{c}"' for i, c in enumerate(badrows.RAW_COLUMNS) if c != "count")},
  coalesce(try_cast({sql.narrow("n")} as bigint), 0) "count", {sql.wire("sm")} start_timestamp, {sql.wire("em")} end_timestamp,
  em - sm duration_minutes, cast(day as varchar) date from w where reason is null
"""

_P2_EDITS = _P2_PARSED + """
select line_id, not quoted quoting, case when quoted then case when len(f) > 9 then 'delete_delimiter:' || (len(f) - 9) when len(f) < 9 then 'insert_delimiter:' || (9 - len(f)) else '' end end operations from w
"""

_P3 = """
with r as (
  select distinct class_name c, epoch_us(cast(start_timestamp as timestamptz)) s, epoch_us(cast(end_timestamp as timestamptz)) e
  from exam_record where class_name <> '' and start_timestamp is not null and end_timestamp is not null),
o as (select *, max(e) over (partition by c order by s, e rows between unbounded preceding and 1 preceding) seen from r where e > s),
i as (select *, sum(case when seen is null or s > seen then 1 else 0 end) over (partition by c order by s, e) k from o),
g as (select c, k, min(s) s, max(e) e, count(*) n from i group by c, k),
w as (select c, 'merged' kind, s, e from g where n > 1 union all
      select c, 'gap', e, lead(s) over (partition by c order by s) from g),
t as (select *, make_timestamp(s + 28800000000) a, make_timestamp(e + 28800000000) b from w where e is not null)
select c class_name, kind, strftime(a, '%Y-%m-%dT%H:%M:%S+08:00') start_timestamp, strftime(b, '%Y-%m-%dT%H:%M:%S+08:00') end_timestamp
from t where kind = 'merged' or cast(a as date) = cast(b as date)
"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _key(c: str) -> str:
    narrow = f"translate({c}, '{_WIDE}', '{_NARROW}')"
    return f"lower(regexp_replace({narrow}, '(?:{sql.SPACE}|[_\\x{{feff}}])+', '', 'g'))"


_ALIAS = f"select {_key('alias')} hk, arg_min(field, alias_pos) f, min(alias_pos) p from header_alias group by 1"


_P6 = f"""
with h as ({_ALIAS}),
c as (select series_id, file_seq, source_file, unnest(json_keys(payload)) k, payload from exam_sheet_row),
t as (select series_id, file_seq, source_file, k, {_key("k")} hk, json_type(json_extract(payload, '$."' || replace(k, '"', '\\"') || '"')) jt from c),
n as (select *, case when jt = 'NULL' then null when jt = 'VARCHAR' then 'string' when jt = 'BOOLEAN' then 'boolean'
             when jt = 'ARRAY' then 'array' when jt = 'OBJECT' then 'object' else 'number' end ty from t),
j as (select n.*, coalesce(h.f, '?' || n.hk) fid, coalesce(h.f, n.k) name, coalesce(h.p, 0) p from n left join h using (hk)),
tc as (select series_id, file_seq, source_file, fid, ty, count(ty) m from j group by all),
ty as (select series_id, file_seq, source_file, fid, arg_min(ty, (-m, ty)) ty from tc where ty is not null group by all),
hd as (select series_id, file_seq, source_file, fid, min(name) name, arg_min(hk, (p, hk)) hk from j group by all),
ff as (select hd.*, ty.ty from hd left join ty using (series_id, file_seq, source_file, fid)),
fl as (select *, row_number() over (partition by series_id order by file_seq, source_file) no,
              lead(source_file) over (partition by series_id order by file_seq, source_file) nx
       from (select distinct series_id, file_seq, source_file from exam_sheet_row)),
x as (select ff.*, no, nx from ff join fl using (series_id, file_seq, source_file)),
b as (select series_id, no + 1 no, nx source_file, fid, name, hk, ty from x where nx is not null),
z as (select coalesce(x.source_file, b.source_file) source_file, coalesce(x.name, b.name) field, x.fid is not null is_now, b.fid is not null was,
             x.hk h1, b.hk h0, x.ty t1, b.ty t0
      from x full join b on x.series_id = b.series_id and x.no = b.no and x.fid = b.fid where coalesce(x.no, b.no) > 1)
select source_file, field, 'added' as change from z where not was union
select source_file, field, 'removed' from z where not is_now union
select source_file, field, 'renamed' from z where was and is_now and h0 <> h1 union
select source_file, field, 'retyped' from z where was and is_now and t0 <> t1
"""

_PROMOTED = {"座位数": "int", "场次": "string"}
_FIT = f"""case when jt in ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then case when {{kind}} <> 'int' then t
  when regexp_full_match(t, '\\s*[+-]?[0-9]+\\s*') then cast(try_cast(trim(t) as int) as varchar) end end"""
_OWN = "sheet_row_id, series_id, file_seq, source_file, row_index, delivered_at"
_P6_STANDARD = f"""
with h as ({_ALIAS}),
c as (select sheet_row_id, payload, unnest(json_keys(payload)) k, generate_subscripts(json_keys(payload), 1) i from exam_sheet_row),
t as (select sheet_row_id, k, i, {_key("k")} hk, json_extract(payload, '$."' || replace(k, '"', '\\"') || '"') v from c),
j as (select t.*, h.f, h.p, json_type(v) jt, json_extract_string(v, '$') t from t left join h using (hk)),
s as (select *, case when jt = 'OBJECT' then '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda x: cast(to_json(x) as varchar) || ':' || cast(json_extract(v, '$."' || x || '"') as varchar)), ',') || '}}'
    else cast(v as varchar) end w, case when f is not null then {_FIT.format(kind="if(f = 'count', 'int', 'string')")} end fit,
  case {" ".join(f"when f is null and hk = {_key(repr(n))} then {_FIT.format(kind=repr(k))}" for n, k in _PROMOTED.items())} end again from j),
r as (select *, again is not null and i = min(i) filter (again is not null) over (partition by sheet_row_id, hk) promoted from s),
g as (select sheet_row_id, {", ".join(f"arg_min(fit, (p, fit)) filter (f = '{x}' and fit is not null) as a_{x}" for x in drift.TARGET)},
  {", ".join(f"any_value(again) filter (promoted and hk = {_key(repr(n))}) as b_{i}" for i, n in enumerate(_PROMOTED))},
  string_agg(cast(to_json(k) as varchar) || ':' || w, ',' order by i) filter (jt <> 'NULL' and fit is null and not promoted) rest from r group by 1)
select {_OWN}, {", ".join(f'cast(a_{x} as {"int" if k == "int" else "varchar"}) as "{x}"' for x, k in drift.TARGET.items())},
  '{{' || rest || '}}' as rescued, {", ".join(f'cast(b_{i} as {"int" if k == "int" else "varchar"}) as "{n}"' for i, (n, k) in enumerate(_PROMOTED.items()))}
from exam_sheet_row left join g using (sheet_row_id)
"""

_QUOTED = '"(?:[^"]|"")*"|“[^”]*”|「[^」]*」'
_P4 = rf"""
with r as (select distinct id, teacher from exam_record where teacher is not null),
g as (select id, teacher, regexp_replace(regexp_replace(teacher, '[ \x{{a0}}]+(?:与|及|and)[ \x{{a0}}]', ';', 'g'), '[ \x{{a0}}]{{2,}}', ';', 'g') t from r),
v as (select id, teacher, list_filter(list_transform(regexp_extract_all(t, '(?:{_QUOTED}|[(（\[][^)）\]]*[)）\]]|[^、，,；;/／|｜&＆\n\r\t\x{{3000}}])+'),
        lambda x: {sql.strip("x")}), lambda x: x <> '') l from g),
u as (select id, teacher, list_transform(l, lambda x: {sql.strip("case when regexp_full_match(x, '" + _QUOTED + "') then replace(x[2:-2], chr(34) || chr(34), chr(34)) else x end")}) l from v where len(l) > 1)
select distinct id, unnest(range(1, len(l) + 1))::int pos, unnest(l) teacher from u
"""

_FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S", "%Y.%m.%d %H:%M", "%Y%m%d%H%M%S", "%Y%m%dT%H%M%S",
    "%Y年%m月%d日 %H:%M", "%Y年%m月%d日 %p %I:%M", "%d %b %Y, %H:%M", "%d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p",
]
_ZONE = "Z|北京时间|(?:UTC|GMT)?[+-][0-9]{1,2}(?::?[0-9]{2})?|UTC|GMT|[A-Z][A-Za-z]+/[A-Za-z_]+"
_P5 = rf"""
with c as (select campus, min(zone_id) home from campus_zone group by 1),
f as (select feed_id, home, {sql.strip("coalesce(start_timestamp, '')")} a, {sql.strip("coalesce(end_timestamp, '')")} b, coalesce(raw_time, '') r from exam_time_feed left join c using (campus)),
g as (select *, regexp_extract(r, '([0-9]{{4}})(?:年|-)([0-9]{{1,2}})(?:月|-)([0-9]{{1,2}}).*?([0-9]{{1,2}}:[0-9]{{2}})[-~至]([0-9]{{1,2}}:[0-9]{{2}})\)?(.*)$', ['y','m','d','s','e','z']) k from f),
s as (select feed_id, home, side, case when a <> '' or b <> '' then if(side = 0, a, b) when k.y = '' then ''
        else k.y || '-' || k.m || '-' || k.d || ' ' || if(side = 0, k.s, k.e) || ' ' || regexp_replace(k.z, '[ ()（）]', '', 'g') end x from g, unnest([0, 1]) u(side)),
b1 as (select *, regexp_replace(regexp_replace({sql.strip("x")}, '\[[^\]]*\]$', ''), '^[A-Z][a-z]{{2}}, ', '') y from s),
b2 as (select *, regexp_extract(y, '[0-9 ]({_ZONE})$', 1) z from b1),
b3 as (select *, case when z = '' then y else y[1:len(y) - len(z)] end w from b2),
b4 as (select *, replace(replace(regexp_replace(trim(w), '(:[0-9]{{2}})\.[0-9]+$', '\1'), '上午', ' AM '), '下午', ' PM ') w2 from b3),
b5 as (select *, try_strptime(w2, {_FORMATS!r}) ts, regexp_extract(z, '^(?:UTC|GMT)?([+-])([0-9]{{1,2}}):?([0-9]{{2}})?$', ['s','h','m']) o from b4),
b6 as (select *, case when z in ('Z', 'UTC', 'GMT') then 0 when z = '北京时间' then 480
             when o.s <> '' then if(o.s = '-', -1, 1) * (try_cast(o.h as int) * 60 + coalesce(try_cast(o.m as int), 0)) end mins, case when contains(z, '/') then z when z = '' then home end zn from b5),
b7 as (select *, case when regexp_full_match(y, '[0-9]{{10}}') then try_cast(y as bigint) when regexp_full_match(y, '[0-9]{{13}}') then try_cast(y as bigint) // 1000
             when mins is not null then epoch_us(ts) // 1000000 - mins * 60
             -- of a time that occurs twice the function takes the later instant
             when zn is not null and ts is not null then epoch_us(case when timezone(zn, timezone(zn, ts) - interval 1 hour) = ts then timezone(zn, ts) - interval 1 hour else timezone(zn, ts) end) // 1000000 end t from b6),
w as (select feed_id, min(t) filter (side = 0) lo, min(t) filter (side = 1) hi from b7 group by 1)
select feed_id, strftime(make_timestamp(lo * 1000000), '%Y-%m-%dT%H:%M:%SZ') start_utc, strftime(make_timestamp(hi * 1000000), '%Y-%m-%dT%H:%M:%SZ') end_utc
from w where lo is not null and hi is not null
"""

ORACLE = {
    "p1_found": _P1,
    "p2_found": _P2_PARSED + "select distinct line_id, reason from w where reason is not null",
    "p2_loaded": _P2_LOADED,
    "p2_edits": _P2_EDITS,
    "p3_found": _P3,
    "p4_found": _P4,
    "p5_found": _P5,
    "p6_found": _P6,
    "p6_standard": _P6_STANDARD,
}
