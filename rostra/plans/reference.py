"""Queries of the timetable operators over whole tables, each with the SQL that checks it.

The SQL is kept apart from the operators: it states the result another way, for another engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import ical
from rostra.functions.display import CARD_DEFAULTS, display
from rostra.functions.text import clean_text, coerce_count
from rostra.operators import calendar, ingest, quality, ranking, report, search, standardize
from rostra.operators.snapshots import wall_micros
from rostra.plans import sql
from rostra.schema import ALIASES, EXCLUDE_WORDS, RECORD_FIELDS, REQUIRED_WORDS, TARGET_WORDS, TEXT_FIELDS
from rostra.session import table
from rostra.sources import records, xlsx
from rostra.sources.html import anchors, notices

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(check: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if check:
            ORACLE[f.__name__] = check
        return f

    return register


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exam_record")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Records as their sheets deliver them: nothing derived yet."""
    return _records(spark, d).select("id", "source_file", "row_index", *ALIASES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exams of all classes that match a term, from raw time texts, in time order."""
    records = standardize.to_records(_raw(spark, d))
    classes = search.matching_classes(records, "星图")
    return search.in_time_order(records.join(classes, "class_name", "left_semi"), "source_file", "row_index")


@query(sql.parsed(f"select id, row_index, {sql.clean('raw_time')} t from exam_record") + f"""
select id, row_index, {sql.wire("sm")} start_timestamp, {sql.wire("em")} end_timestamp, coalesce(em - sm, 0) duration_minutes,
       cast(day as varchar) date, error parse_error from parsed""")  # fmt: skip
def q01_time_range_parse(spark, d):
    out = standardize.to_records(_raw(spark, d))
    return out.select("id", "row_index", "start_timestamp", "end_timestamp", "duration_minutes", "date", "parse_error")


@query("select id, row_index, " + ", ".join(f"{sql.clean(f)} {f}" for f in TEXT_FIELDS) + " from exam_record")
def q02_text_clean(spark, d):
    return _records(spark, d).select("id", "row_index", *[clean_text(F.col(f)).alias(f) for f in TEXT_FIELDS])


_SEVENTH = "^(?:[^,]*,){6}([^,]*)"


@query(rf"""
with a as (select line_id, replace(regexp_extract(line, '{_SEVENTH}', 1), '"', '') cell from exam_raw_line),
b as (select *, {sql.narrow(sql.strip("cell"))} n from a)
select line_id, cell, coalesce(case when regexp_full_match(n, '[+-]?[0-9]+(_[0-9]+)*') then try_cast(replace(n, '_', '') as bigint) end, 0) as n from b""")
def q03_count_coerce(spark, d):
    cell = F.replace(F.regexp_extract("line", _SEVENTH, 1), F.lit('"'), F.lit(""))
    return table(spark, d, "exam_raw_line").select("line_id", cell.alias("cell")).withColumn("n", coerce_count(F.col("cell")))


def _sheets(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two shapes of sheets, as their headers name the columns."""
    r = _records(spark, d)
    a = {"校区": "campus", "开课学院": "school", "课程代码": "course_code", "班级名称": "class_name", "人数": "count", "考试时间": "raw_time", "考试教室": "location", "其他": "notes"}
    b = {"校区名称": "campus", "选课课号": "course_code", "课程代码": "course_name", "行政班级": "class_name", "学生人数": "count", "时间": "raw_time", "教室名称": "location", "年级": "grade", "备注": "notes"}
    return [r.select("id", "row_index", F.lit(s).alias("shape"), *[F.col(v).alias(k) for k, v in m.items()]) for s, m in (("a", a), ("b", b))]


_UNION_FIELDS = ["campus", "course_code", "class_name", "location", "grade", "notes"]


@query(f"""
select id, row_index, 'a' shape, {", ".join(f"{sql.clean(f)} {f}" for f in _UNION_FIELDS[:4])}, '' grade, '' notes, coalesce("count", 0) n from exam_record
union all
select id, row_index, 'b', {sql.clean("campus")}, {sql.clean("course_name")}, {", ".join(sql.clean(f) for f in _UNION_FIELDS[2:])}, coalesce("count", 0) from exam_record""")
def q04_alias_resolve_union(spark, d):
    out = standardize.standardize(_sheets(spark, d), ["id", "row_index", "shape"])
    return out.select("id", "row_index", "shape", *_UNION_FIELDS, F.col("count").alias("n"))


@query("""
select source_file, row_index, row_number() over (partition by source_file order by row_index, ingested_at) + 1 row_no,
       source_file || '-' || (row_number() over (partition by source_file order by row_index, ingested_at) + 1) row_id from exam_record""")
def q05_surrogate_row_id(spark, d):
    r = _records(spark, d).select("source_file", "row_index", "ingested_at")
    return standardize.number_rows(r, "source_file", ["row_index", "ingested_at"]).select("source_file", "row_index", "row_no", "row_id")


_PROFILED = RECORD_FIELDS


@query(" union all ".join(f"""
select '{c}' "column", '{"int64" if c in ("count", "duration_minutes") else "object"}' kind, count("{c}") non_null, count(*) - count("{c}") nulls,
       case when count(*) = 0 then 0.0 else round_even(cast(count("{c}") * 100 as decimal(38,8)) / count(*), 1) end non_null_pct, count(distinct "{c}") n_distinct from exam_record""" for c in _PROFILED))  # fmt: skip
def q06_column_profile(spark, d):
    return quality.column_profile(_records(spark, d), _PROFILED)


_SAMPLED = ["campus", "course_code", "class_name", "teacher", "location", "school", "grade", "notes", "parse_error"]


@query("with v as (" + " union all ".join(f"""
  select '{c}' "column", "{c}" v, min((source_file, row_index, ingested_at)) as pos from exam_record where "{c}" is not null group by 2""" for c in _SAMPLED) + """),
r as (select *, row_number() over (partition by "column" order by pos, v) k from v)
select "column", string_agg(left(v, 30), ', ' order by k) samples from r where k <= 3 group by 1""")  # fmt: skip
def q07_first_values(spark, d):
    order = [F.col("source_file"), F.col("row_index"), F.col("ingested_at")]
    return quality.first_values(_records(spark, d), _SAMPLED, order)


@query("""
with c as (select source_file, campus, count(*) n, min(row_index) f from exam_record where campus <> '' group by all)
select source_file, campus, n, row_number() over (partition by source_file order by f, campus) place from c""")
def q08_campus_histogram(spark, d):
    return quality.campus_histogram(_records(spark, d), "source_file", "row_index")


_STATS = """
with s as (select source_file, count(*) n_rows, count(*) filter (parse_error is null) parsed, count(*) filter (parse_error is not null) failed,
  count(distinct nullif(class_name, '')) classes, count(distinct nullif(course_name, '')) courses, min(nullif(date, '')) first_date, max(nullif(date, '')) last_date,
  coalesce(round_even(cast(sum(duration_minutes) filter (duration_minutes > 0) as decimal(38,8)) / count(*) filter (duration_minutes > 0), 1), 0.0) avg_minutes
  from exam_record group by 1)
"""


@query(_STATS + "select *, coalesce(first_date || ' ~ ' || last_date, 'N/A') date_range, failed > 0 has_errors from s")
def q09_file_statistics(spark, d):
    return quality.file_statistics(_records(spark, d), "source_file")


@query(_STATS + """
select count(*) files, cast(sum(n_rows) as bigint) records, cast(sum(parsed) as bigint) parsed, cast(sum(failed) as bigint) failed,
       cast(sum(classes) as bigint) classes_approx, cast(sum(courses) as bigint) courses_approx,
       case when min(first_date) <> max(last_date) then min(first_date) || ' ~ ' || max(last_date) else 'N/A' end date_range,
       sum(parsed) || '/' || (sum(parsed) + sum(failed)) || ' (' || round_even(cast(sum(parsed) * 100 as decimal(38,8)) / (sum(parsed) + sum(failed)), 1) || '%)' success from s""")
def q10_overall_statistics(spark, d):
    return quality.overall_statistics(quality.file_statistics(_records(spark, d), "source_file"))


@query("""
with b as (select *, row_number() over (partition by source_file order by row_index, raw_time) place, count(*) over (partition by source_file) n
           from exam_record where parse_error is not null)
select source_file, place, 'Row ' || row_index || ': ' || parse_error || ' (Raw: ''' || raw_time || ''')' message, greatest(n - 10, 0) more from b where place <= 10""")
def q11_first_errors(spark, d):
    return quality.first_errors(_records(spark, d), "source_file", "row_index")


@query("""
with c as (select distinct class_name from exam_record where class_name <> '' and contains(upper(class_name), '24A'))
select row_number() over (order by class_name) place, class_name, greatest((select count(*) from c) - 50, 0) more from c order by class_name limit 50""")
def q12_class_search(spark, d):
    return search.listed_classes(_records(spark, d), " 24a ")


_TERMS = [("  ", None), ("星", None), ("星图", None), (" 22a0000000", None), ("zz-none", None), ("全校通选班", None), ("xx", "全校通选班"), ("xx", "no such"), ("x", "全校通选班"), ("", None)]
_TERMS_SQL = ", ".join("('" + t + "', " + (f"'{c}'" if c else "null") + ")" for t, c in _TERMS)


@query(f"""
with t(term, chosen) as (values {_TERMS_SQL}),
c as (select class_name, count(*) n from exam_record where class_name <> '' group by 1),
m as (select term, chosen, length(term) >= 2 active, count(class_name) classes, coalesce(sum(n), 0) exams
      from t left join c on length(term) >= 2 and (case when chosen is not null then class_name = chosen else contains(upper(class_name), upper(trim(term))) end) group by all)
select term, chosen, case when not active then 'EMPTY' when chosen is not null then 'DETAIL' when classes = 0 then 'NOT_FOUND' when classes = 1 then 'DETAIL' else 'LIST' end as mode,
       classes, case when active and (chosen is not null or classes = 1) then cast(exams as bigint) end exams from m""")
def q13_search_modes(spark, d):
    return search.search_modes(_records(spark, d), spark.createDataFrame(_TERMS, "term string, chosen string"))


@query("""
select id, row_index, start_timestamp from exam_record
where start_timestamp is not null and id in (select id from exam_record where class_name = '全校通选班')""")
def q14_selected_exams(spark, d):
    chosen = _records(spark, d).filter("class_name = '全校通选班'").select("id")
    return search.selected(_records(spark, d), chosen).select("id", "row_index", "start_timestamp")


@query("""
select id, m as minutes, epoch_us(cast(start_timestamp as timestamptz)) // 1000000 - m * 60 remind_s
from exam_record, unnest([15, 30, 60, 1440]) u(m) where start_timestamp is not null""")
def q15_reminders(spark, d):
    return calendar.reminders_of(_records(spark, d), [60, 15, 1440, 30, 30])


def _in(c: str, words: list[str], how: str) -> str:
    return "(" + f" {how} ".join(f"contains({c}, '{w}')" for w in words) + ")"


_TITLE_OK = f"(not {_in('title', EXCLUDE_WORDS, 'or')} and {_in('title', REQUIRED_WORDS, 'and')} and {_in('title', TARGET_WORDS, 'or')})"


@query(f"with t as (select doc_id, text title from documents) select doc_id, coalesce({_TITLE_OK}, false) valid, "
       f"coalesce({_in('title', EXCLUDE_WORDS, 'or')}, false) excluded, coalesce({_in('title', TARGET_WORDS, 'or')}, false) target from t")  # fmt: skip
def q16_title_filter(spark, d):
    flag = lambda words: F.coalesce(ingest._any(F.col("text"), words), F.lit(False))
    return table(spark, d, "documents").select(
        "doc_id", ingest.is_schedule_title(F.col("text")).alias("valid"), flag(EXCLUDE_WORDS).alias("excluded"), flag(TARGET_WORDS).alias("target")
    )


@query("""
with f as (select distinct series_id page, case when series_id % 3 = 0 then if(file_seq % 3 = 0, '巡考_', '') when file_seq % 4 = 0 then '学生版_'
             when file_seq % 4 = 1 then '监考_' else '' end || source_file as name from exam_sheet_row),
a as (select page, bool_or(contains(name, '学生')) any_student from f group by 1)
select page, name from f join a using (page)
where case when any_student then contains(name, '学生') else not (contains(name, '监考') or contains(name, '教师') or contains(name, '巡考') or contains(name, '教务员')) end""")
def q17_attachment_choice(spark, d):
    seq, page = F.col("file_seq"), F.col("series_id")
    prefix = F.when(page % 3 != 0, F.when(seq % 4 == 0, "学生版_").when(seq % 4 == 1, "监考_").otherwise("")).otherwise(F.when(seq % 3 == 0, "巡考_").otherwise(""))
    files = table(spark, d, "exam_sheet_row").select(page.alias("page"), F.concat(prefix, "source_file").alias("name")).distinct()
    return ingest.chosen_attachments(files, "page")


_DIGEST = "md5(coalesce(location, '') || '|' || coalesce(start_timestamp, ''))"


@query(f"""
with s as (select snapshot_no, id, max({_DIGEST}) digest from exam_snapshot group by all),
n as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) nxt from (select distinct snapshot_no from s)),
o as (select nxt || '/' || id as name, digest from s join n using (snapshot_no) where nxt is not null),
w as (select snapshot_no || '/' || id as name, digest from s where snapshot_no > (select min(snapshot_no) from s))
select coalesce(o.name, w.name) as name, case when o.name is null then 'added' when w.name is null then 'removed' when o.digest = w.digest then 'same' else 'changed' end as status
from o full join w on o.name = w.name""")
def q18_file_changes(spark, d):
    """Every delivery against the one before it."""
    t = table(spark, d, "exam_snapshot")
    digest = F.md5(F.concat(F.coalesce("location", F.lit("")), F.lit("|"), F.coalesce("start_timestamp", F.lit(""))))
    state = t.groupBy("snapshot_no", "id").agg(F.max(digest).alias("digest"))
    numbers = ranking.numbered(t.select("snapshot_no").distinct(), [], ["snapshot_no"], "k")
    following = numbers.join(numbers.select(F.col("snapshot_no").alias("next"), (F.col("k") - 1).alias("k")), "k").select("snapshot_no", "next")
    old = state.join(following, "snapshot_no").select(F.concat_ws("/", "next", "id").alias("name"), "digest")
    new = state.join(following.select(F.col("next").alias("snapshot_no")), "snapshot_no").select(F.concat_ws("/", "snapshot_no", "id").alias("name"), "digest")
    return ingest.file_changes(old, new)


@query("""
with a as (select id, class_name, notes, row_index from exam_record), b as (select id, class_name, notes || ' ' as notes, row_index from exam_record)
select 'same' pair, not exists (select * from a except all select * from a) and not exists (select * from a except all select * from a) equal
union all select 'other', not exists (select * from a except all select * from b) and not exists (select * from b except all select * from a)""")
def q19_dataset_equality(spark, d):
    a = _records(spark, d).select("id", "class_name", "notes", "row_index")
    b = a.withColumn("notes", F.concat("notes", F.lit(" "))).select(*a.columns)
    pairs = (("same", a), ("other", b))
    rows = [ingest.rows_differ(a, x).select(F.lit(name).alias("pair"), "equal") for name, x in pairs]
    return rows[0].unionAll(rows[1])


_ESC = lambda c: f"replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), ',', chr(92) || ','), ';', chr(92) || ';'), chr(10), chr(92) || 'n')"
_DESC = """concat_ws(chr(10), '课程代码: ' || coalesce(nullif(course_code, ''), '-'), '教师: ' || coalesce(nullif(teacher, ''), '未知'), '班级: ' || coalesce(class_name, ''),
  '人数: ' || coalesce("count", 0), case when notes <> '' then '备注: ' || notes end, 'footer')"""
_STAMP_SQL = "regexp_replace(regexp_replace(regexp_replace(nullif({c}, ''), '([+-][0-9]{{2}}:?[0-9]{{2}}|Z)$', ''), '[-:]', '', 'g'), '\\.[0-9]+$', '')"


@query(f"""
select id, row_index, {_STAMP_SQL.format(c="start_timestamp")} dtstart, {_STAMP_SQL.format(c="end_timestamp")} dtend,
  {_ESC("'考试: ' || coalesce(course_name, '')")} summary, {_ESC("case when coalesce(campus, '') <> '' then '[' || campus || '] ' else '' end || coalesce(location, '')")} place,
  {_ESC(_DESC)} description from exam_record""")
def q20_calendar_fields(spark, d):
    c = F.col
    return _records(spark, d).select(
        "id", "row_index", ical.calendar_stamp(c("start_timestamp")).alias("dtstart"), ical.calendar_stamp(c("end_timestamp")).alias("dtend"),
        ical.escape(F.concat(F.lit("考试: "), F.coalesce("course_name", F.lit("")))).alias("summary"), ical.escape(ical.place(c("campus"), c("location"))).alias("place"),
        ical.escape(ical.description(c("course_code"), c("teacher"), c("class_name"), c("count"), c("notes"), "footer")).alias("description"),
    )


@query("""
with h as (select id, row_index, list_reduce(list_prepend(0::bigint, list_transform(string_split(id, ''), lambda x: ord(x)::bigint)), lambda a, b: (a * 31 + b) % 4294967296) u from exam_record)
select id, row_index, 'exam-' || lower(to_base(abs(case when u >= 2147483648 then u - 4294967296 else u end), 36)) || '-' || row_index || '@example.org' uid from h""")
def q21_calendar_uid(spark, d):
    return _records(spark, d).select("id", "row_index", ical.uid(F.col("id"), F.col("row_index"), "example.org").alias("uid"))


@query(f"""
select id, row_index, list_reduce(string_split('DESCRIPTION:' || {_ESC(_DESC)}, ''),
  lambda a, c: a || case when strlen(regexp_extract(a, '[^\\n]*$')) + strlen(c) > 75 then chr(13) || chr(10) || ' ' else '' end || c) folded from exam_record""")
def q22_calendar_fold(spark, d):
    c = F.col
    text = ical.escape(ical.description(c("course_code"), c("teacher"), c("class_name"), c("count"), c("notes"), "footer"))
    return _records(spark, d).select("id", "row_index", ical.fold(F.concat(F.lit("DESCRIPTION:"), text)).alias("folded"))


_HTML = """'<div class="col_news_con"><ul><li class="news"><a href="../files/' || row_index || '/' || source_file || '" title="x"><b>' || source_file || '</b></a></li>' ||
  '<li><a class="m" href="page.htm?x=' || file_seq || '">more</a><a href="/up/a*' || file_seq || '.XLS">open</a></li></ul></div>'"""
_BASE = "https://example.org/a/b/list.htm"


@query(f"""
with p as (select sheet_row_id, {_HTML} html from exam_sheet_row),
l as (select sheet_row_id, unnest(regexp_extract_all(html, '<a[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1)) href, unnest(regexp_extract_all(html, '<a[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1)) inner_html from p),
t as (select sheet_row_id, href, regexp_replace(inner_html, '<[^>]*>', '', 'g') text from l where regexp_matches(lower(href), '\\.xlsx?$'))
select sheet_row_id, href, case when starts_with(href, '../') then 'https://example.org/a/' || href[4:] when starts_with(href, '/') then 'https://example.org' || href else 'https://example.org/a/b/' || href end url,
  regexp_replace(case when regexp_matches(lower(text), '\\.xlsx?$') then text else regexp_extract(href, '[^/]*$') end, '[\\\\/*?:"<>|]', '', 'g') as name from t""")
def q23_link_extract(spark, d):
    c, text = F.col, F.lit
    html = F.concat(
        text('<div class="col_news_con"><ul><li class="news"><a href="../files/'), c("row_index"), text("/"), c("source_file"), text('" title="x"><b>'), c("source_file"), text("</b></a></li>"),
        text('<li><a class="m" href="page.htm?x='), c("file_seq"), text('">more</a><a href="/up/a*'), c("file_seq"), text('.XLS">open</a></li></ul></div>'),
    )
    links = table(spark, d, "exam_sheet_row").select("sheet_row_id", F.explode(anchors(html)).alias("l")).select("sheet_row_id", "l.href", "l.text")
    return links.filter(ingest.is_workbook_link(c("href"))).select(
        "sheet_row_id", "href", ingest.absolute_url(_BASE, c("href")).alias("url"), ingest.attachment_name(c("text"), c("href")).alias("name")
    )


@query("""
with s as (select course_code, list_sort(list(distinct row_index % 5)) chosen from exam_record where course_code is not null group by 1)
select course_code, list_sort(case when list_contains(chosen, 3) then list_filter(chosen, lambda x: x <> 3) else list_append(chosen, 3) end)::varchar toggled from s""")
def q24_toggle_sets(spark, d):
    sets = _records(spark, d).filter("course_code is not null").groupBy("course_code").agg(F.collect_set(F.col("row_index") % 5).alias("chosen"))
    return sets.select("course_code", F.array_sort(ical.toggle(F.col("chosen"), F.lit(3))).cast("string").alias("toggled"))


@query("""
with e as (select event_id, epoch_us(ts) // 1000000 s from events)
select event_id, s // 86400 as "days", (s // 3600) % 24 as "hours", (s // 60) % 60 as "minutes", s % 60 as "seconds" from e""")
def q25_elapsed(spark, d):
    t = table(spark, d, "events")
    return t.select("event_id", ical.elapsed(F.floor(wall_micros(t, "ts") / 1_000_000)).alias("e")).select("event_id", "e.*")


@query("with c as (select distinct id from exam_record where class_name = '全校通选班'), t as (select *, epoch_us(cast(start_timestamp as timestamptz)) // 1000000 + 28800 w from exam_record), "
       "d as (select *, make_timestamp(w * 1000000) at8 from t) select d.id, row_index, " + ", ".join(f"coalesce(nullif({c}, ''), '{v}') {c}" for c, v in CARD_DEFAULTS.items()) + """, coalesce(cast("count" as varchar), '-') as "count",
  coalesce(month(at8) || '月' || day(at8) || '日周' || ('日一二三四五六')[dayofweek(at8) + 1] || ' ' || strftime(at8, '%H:%M'), '') shown_date, c.id is not null is_selected
  from d left join c on c.id = d.id""")  # fmt: skip
def q26_cards(spark, d):
    r = _records(spark, d)
    return search.cards(r, r.filter("class_name = '全校通选班'").select("id"))


@query("select doc_id, replace(left(text, 25), chr(10), ' ') short, replace(replace(left(text, 20), chr(10), ' '), '|', '/') raw from documents")
def q27_display_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", display(F.col("text"), 25).alias("short"), display(F.col("text"), 20, True).alias("raw"))


@query("select id, row_index, case when coalesce(class_name, '') <> '' then class_name end as chosen from exam_record")
def q28_share_class(spark, d):
    """The class that the share URL of a record selects again: encoded and decoded."""
    url = search.share_url("https://example.org/", F.col("class_name"))
    return _records(spark, d).select("id", "row_index", search.share_class(url).alias("chosen"))


@query("""
select source_file, row_index, row_number() over (partition by source_file order by start_timestamp nulls last, row_index, ingested_at) place from exam_record""")
def q29_time_order(spark, d):
    r = _records(spark, d).select("source_file", "row_index", "start_timestamp", "ingested_at")
    order = [F.col("start_timestamp").asc_nulls_last(), "row_index", "ingested_at"]
    return ranking.numbered(r, ["source_file"], order, "place").select("source_file", "row_index", "place")


_FOLDED = """case when strlen({c}) <= 75 then {c} else list_reduce(string_split({c}, ''),
  lambda a, c: a || case when strlen(regexp_extract(a, '[^\\n]*$')) + strlen(c) > 75 then chr(13) || chr(10) || ' ' else '' end || c) end"""
_UID = """'exam-' || lower(to_base(abs(case when u >= 2147483648 then u - 4294967296 else u end), 36)) || '-' || {n} || '@example.org'"""
# Lines of a calendar file.
_ALARM = ["BEGIN:VALARM", "ACTION:DISPLAY", "DESCRIPTION:Exam Reminder", "TRIGGER:-PT{m}M", "END:VALARM"]
_HEAD = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//rostra//timetable//EN", "X-WR-CALNAME:", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "BEGIN:VTIMEZONE", "TZID:Asia/Shanghai",
         "X-LIC-LOCATION:Asia/Shanghai", "BEGIN:STANDARD", "TZOFFSETFROM:+0800", "TZOFFSETTO:+0800", "TZNAME:CST", "DTSTART:19700101T000000", "END:STANDARD", "END:VTIMEZONE"]


@query(f"""
with e as (select *, row_number() over (partition by class_name order by start_timestamp nulls last, id, ingested_at) - 1 n,
    list_reduce(list_prepend(0::bigint, list_transform(string_split(id, ''), lambda x: ord(x)::bigint)), lambda a, b: (a * 31 + b) % 4294967296) u
  from exam_record where class_name <> ''),
l as (select class_name, n as event, unnest(ls) line, unnest(range(len(ls))) line_no from (select class_name, n, [
    'BEGIN:VEVENT', 'UID:' || {_UID.format(n="n")}, 'DTSTAMP:20260101T000000Z', 'DTSTART;TZID=Asia/Shanghai:' || {_STAMP_SQL.format(c="start_timestamp")},
    'DTEND;TZID=Asia/Shanghai:' || {_STAMP_SQL.format(c="end_timestamp")}, 'SUMMARY:' || {_ESC("'考试: ' || coalesce(course_name, '')")},
    'LOCATION:' || {_ESC("case when coalesce(campus, '') <> '' then '[' || campus || '] ' else '' end || coalesce(location, '')")}, 'DESCRIPTION:' || {_ESC(_DESC)},
    'STATUS:CONFIRMED', {", ".join(repr(x.format(m=m)) for m in (30, 60) for x in _ALARM)}, 'END:VEVENT'] ls from e where start_timestamp <> '' and end_timestamp <> '')
  union all select class_name, -1, unnest(ls), unnest(range(len(ls))) from (select class_name, {[*_HEAD]} ls from (select distinct class_name from e))
  union all select distinct class_name, 2147483647, 'END:VCALENDAR', 0 from e),
m as (select class_name, event, line_no, if(line = 'X-WR-CALNAME:', line || class_name, line) line from l)
select class_name, cast(event as bigint) event, cast(line_no as int) line_no, {_FOLDED.format(c="line")} line from m""")
def q30_calendar_lines(spark, d):
    """The calendar files of all classes, as lines."""
    r = _records(spark, d).filter("class_name <> ''")
    return calendar.calendar_lines(r, "class_name", "20260101T000000Z", footer="footer", order=("start_timestamp", "id", "ingested_at"))


_NOTICE = """campus || ' 2025-2026学年第' || (row_index % 2 + 1) || '学期' || coalesce(course_name, '') || case row_index % 7 when 0 then '期末考试安排表' when 1 then '补考安排'
  when 2 then '课程结束考试（重修）' when 3 then '课程结束考试' when 4 then '期末考试监考' when 5 then '成绩公布' else '考试安排表' end"""


@query(f"""
with t as (select id || ingested_at::varchar pos, {_NOTICE} title from exam_record) select pos, title from t where {_TITLE_OK} order by pos limit 1""")
def q31_newest_notice(spark, d):
    return ingest.newest_notice(_records(spark, d).select(F.concat("id", F.col("ingested_at").cast("string")).alias("pos"), F.expr(_NOTICE).alias("title")))


@query(f"""
with t as (select id, row_index, {_NOTICE} title from exam_record)
select id, row_index, title, coalesce({_TITLE_OK}, false) valid from t""")
def q38_notice_titles(spark, d):
    """FLT-1 over titles of which some are valid, some have an excluding word, and some lack the target."""
    t = _records(spark, d).select("id", "row_index", F.expr(_NOTICE).alias("title"))
    return t.withColumn("valid", ingest.is_schedule_title(F.col("title")))


@query("""
select '2026-01-01T00:00:00+08:00' generated_at, to_json(list_sort(list(distinct source_file))) files_processed, count(*) total_records,
       'https://example.org/n' source_url, null::varchar source_title from exam_record""")
def q32_manifest(spark, d):
    source = spark.createDataFrame([("https://example.org/n", None)], "source_url string, source_title string")
    out = report.manifest(_records(spark, d), "source_file", "2026-01-01T00:00:00+08:00", source)
    return out.withColumn("files_processed", F.to_json("files_processed"))


@query("select id, row_index, to_json(struct_pack(" + ", ".join(f'"{f}" := "{f}"' for f in RECORD_FIELDS) + ")) json from exam_record")
def q33_record_json(spark, d):
    return _records(spark, d).select("id", "row_index", report.record_json(_records(spark, d)).alias("json"))


@query("""
with r as (select source_file, row_index, class_name, row_number() over (partition by source_file order by row_index, ingested_at) k from exam_record)
select source_file, row_index, class_name from r where k <= 3""")
def q34_first_rows(spark, d):
    r = _records(spark, d).select("source_file", "row_index", "class_name", "ingested_at")
    return ingest.first_row_per(r, ["source_file"], ["row_index", "ingested_at"], 3).drop("ingested_at")


@query("""
with c as (select distinct source_file, unnest(json_keys(payload)) k from exam_sheet_row where source_file is not null),
h as (select source_file, field, arg_min(k, alias_pos) "column" from c join header_alias on k = alias group by all),
f as (select * from (select distinct source_file from c), (select distinct field from header_alias))
select source_file, field, "column", "column" is not null mapped from f left join h using (source_file, field)""")
def q35_alias_join(spark, d):
    """JOIN-3 over all files: exact headers, first alias wins."""
    keys = F.explode(F.json_object_keys("payload")).alias("column")
    columns = table(spark, d, "exam_sheet_row").filter("source_file is not null").select("source_file", keys).distinct()
    return standardize.resolve_by_join(columns, table(spark, d, "header_alias"), ["source_file"])


@query("""
with e as (select distinct id from exam_record where class_name = '全校通选班'),
k as (select id from e where id not in (select id from exam_record where class_name = '全校通选班' and contains(notes, '开卷')))
select (select count(*) from k) selected, (select count(*) from e) total""")
def q36_selection_state(spark, d):
    r = _records(spark, d)
    return search.selection_state(r, "全校通选班", r.filter("class_name = '全校通选班' and contains(notes, '开卷')"))


_BLOCK = "source_file || '-' || (row_index // 100)"
_KIND = "(row_index // 100) % 7"  # 3: cut off, 5: no workbook at all; the odd others have other headers
_BOOK_COLUMNS = {
    0: {"课程代码": "course_code", "班级名称": "class_name", "人数": "count", "考试时间": "raw_time", "考试教室": "location"},
    1: {"教室名称": "location", "其他": "notes", "选课课号": "course_code", "行政班级": "class_name", "学生人数": "count", "时间": "raw_time"},
}


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks (path, content) of up to 100 row numbers of a file each, some of them damaged."""
    names = [*dict.fromkeys(c for columns in _BOOK_COLUMNS.values() for c in columns.values())]

    def make(key, pdf):
        kind, columns = key[1], _BOOK_COLUMNS[key[1] % 2]
        pdf = pdf.sort_values(["row_index", "at"])
        cells = [[None if v is None or v != v else int(v) if c == "count" else v for c, v in zip(columns.values(), r, strict=True)] for r in pdf[list(columns.values())].itertuples(index=False)]
        content = xlsx.workbook_bytes(list(columns), cells)
        content = content[: len(content) // 2] if kind == 3 else b"not a workbook" if kind == 5 else content
        return pd.DataFrame({"path": [f"/in/{key[0]}.xlsx"], "content": [content]})

    block = F.floor(F.col("row_index") / 100).cast("int")
    r = _records(spark, d).select(F.concat("source_file", F.lit("-"), block).alias("name"), (block % 7).alias("kind"), "row_index", F.col("ingested_at").cast("string").alias("at"), *names)
    return r.groupBy("name", "kind").applyInPandas(make, "path string, content binary")


_BOOK_ROWS = f"select *, {_BLOCK} || '.xlsx' as book, {_KIND} as kind from exam_record where source_file is not null and row_index is not null"


@query(f"""
with b as (select distinct book, kind from ({_BOOK_ROWS}))
select count(*) filter (kind not in (3, 5)) fetched, count(*) filter (kind in (3, 5)) failed, count(*) filter (kind not in (3, 5)) > 0 as "any" from b""")
def q37_fetch_summary(spark, d):
    parts = xlsx.read_workbooks(_books(spark, d)).filter("part <> 'row'")
    return ingest.fetch_summary(parts.select((F.col("part") == "header").alias("ok")))


@query(f"""
with b as ({_BOOK_ROWS})
select book source_file, row_number() over (partition by book order by row_index, ingested_at) + 1 row_index, {", ".join(f"nullif({c}, '') {c}" for c in ("course_code", "class_name", "raw_time", "location"))}, cast("count" as varchar) "count"
from b where kind not in (3, 5)""")
def q39_workbook_rows(spark, d):
    """SRC-2, PRJ-1/2 and FLT-16: rows of the workbooks that can be read, each by its own headers, beside damaged ones."""
    rows = xlsx.standard_rows(xlsx.read_workbooks(_books(spark, d)))
    return rows.select("source_file", "row_index", "course_code", "class_name", "raw_time", "location", "count")


@query(f"with b as ({_BOOK_ROWS}) select distinct book source_file, 'BadZipFile: File is not a zip file' as error from b where kind in (3, 5)")
def q40_failed_files(spark, d):
    return xlsx.failed_files(xlsx.read_workbooks(_books(spark, d)))


_CHANGED = "case doc_id % 5 when 0 then null when 1 then text || '.' else text end"


_PAGE = """'<div class="col_news_con"><ul><li class="news"><span class="news_title">' || case when row_index % 3 = 0 then '' else '<a href="n' || row_index || '.htm" title="' || source_file || '">t</a>' end
  || '</span><a href="../x/./y' || file_seq || '.htm">' || source_file || '</a></li><li class="news">none</li><li class="news"><a href="/a/../b' || series_id || '.htm">last</a></li></ul></div><a href="far.htm">far</a>'"""


@query(f"""
with p as (select sheet_row_id, row_index, file_seq, series_id, source_file from exam_sheet_row where source_file is not null),
n as (select sheet_row_id, 1 item, if(row_index % 3 = 0, 'https://example.org/a/x/y' || file_seq || '.htm', 'https://example.org/a/b/n' || row_index || '.htm') url, source_file title from p
  union all select sheet_row_id, 3, 'https://example.org/b' || series_id || '.htm', 'last' from p)
select * from n""")
def q47_notices(spark, d):
    """SRC-4, PRJ-15, PRJ-17: items of a notice list, with the anchor of the title or the first one, and dot segments anywhere."""
    pages = table(spark, d, "exam_sheet_row").filter("source_file is not null").select("sheet_row_id", F.expr(_PAGE).alias("html"))
    found = notices(pages, "sheet_row_id")
    return found.select("sheet_row_id", "item", ingest.absolute_url(_BASE, F.col("href")).alias("url"), ingest.notice_title(F.col("title"), F.col("text")).alias("title"))


@query(f"""
with o as (select doc_id || '.xls' as name, md5(text) digest from documents where text is not null), n as (select doc_id || '.xls' as name, md5({_CHANGED}) digest from documents where {_CHANGED} is not null)
select coalesce(o.name, n.name) as name, case when o.name is null then 'added' when n.name is null then 'removed' when o.digest = n.digest then 'same' else 'changed' end as status
from o full join n on o.name = n.name""")
def q41_content_changes(spark, d):
    """JOIN-4 and SRC-7: which files of a delivery differ from the last one in their bytes."""
    t = table(spark, d, "documents")
    name = F.concat(F.lit("/in/"), "doc_id", F.lit(".xls")).alias("path")
    old = t.filter("text is not null").select(name, F.encode("text", "UTF-8").alias("content"))
    new = t.withColumn("text", F.expr(_CHANGED)).filter("text is not null").select(name, F.encode("text", "UTF-8").alias("content"))
    return ingest.file_changes(xlsx.workbook_digests(old), xlsx.workbook_digests(new))


_SORTED = """case when json_type(v) = 'OBJECT' then '{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda x: cast(to_json(x) as varchar) || ':' || cast(json_extract(v, '$."' || x || '"') as varchar)), ',') || '}'
  when json_type(v) = 'ARRAY' then cast(v as varchar) else json_extract_string(v, '$') end"""
_CELLS_SQL = f"""
r as (select sheet_row_id, source_file, row_index, payload from exam_sheet_row where source_file is not null),
c0 as (select sheet_row_id, source_file, row_index, unnest(json_keys(payload)) "column", generate_subscripts(json_keys(payload), 1) - 1 pos, payload from r),
c1 as (select *, json_extract(payload, '$."' || "column" || '"') v from c0),
c as (select * exclude v, case json_type(v) when 'NULL' then null when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' when 'UBIGINT' then 'int' when 'BIGINT' then 'int'
        when 'ARRAY' then 'object' when 'OBJECT' then 'object' else 'float' end k, {_SORTED} as value from c1)"""


def _json_sheets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "exam_sheet_row").filter("source_file is not null")
    return t.select("source_file", "row_index", records.json_cells(F.col("payload")).alias("cells"))


@query(f"""
with {_CELLS_SQL},
n as (select source_file, count(*) n from r group by 1),
d as (select source_file, "column", k, value, min(row_index) f from c where value is not null group by all),
s as (select *, row_number() over (partition by source_file, "column" order by f, value, k) p from d),
t as (select source_file, "column", string_agg(left(value, 30), ', ' order by p) samples from s where p <= 3 group by all),
g as (select source_file, "column", min(pos) pos, count(value) non_null, count(distinct (k, value)) filter (value is not null) n_distinct, list(distinct k) filter (value is not null) ks from c group by all)
select source_file, "column", row_number() over (partition by source_file order by pos, "column") place,
  case when ks = ['int'] and non_null = n then 'int64' when len(list_filter(coalesce(ks, []), lambda x: x not in ('int', 'float'))) = 0 then 'float64' when ks = ['bool'] and non_null = n then 'bool' else 'object' end kind,
  non_null, n - non_null nulls, round_even(cast(non_null * 100 as decimal(38,8)) / n, 1) non_null_pct, n_distinct, samples
from g join n using (source_file) left join t using (source_file, "column")""")
def q42_sheet_profile(spark, d):
    return quality.sheet_profile(_json_sheets(spark, d), "source_file", "row_index")


@query(f"""
with {_CELLS_SQL},
p as (select sheet_row_id, row_number() over (partition by source_file order by row_index, payload) place from r)
select source_file, place, pos, replace(left("column", 15), chr(10), ' ') "column", replace(replace(left(value, 20), chr(10), ' '), '|', '/') as value
from c join p using (sheet_row_id) where place <= 3""")
def q43_raw_samples(spark, d):
    return quality.raw_samples(_json_sheets(spark, d), "source_file", "row_index")


@query("""
with c as (select distinct source_file, unnest(json_keys(payload)) k from exam_sheet_row where source_file is not null),
h as (select source_file, field, arg_min(k, alias_pos) k from c join header_alias on k = alias group by all)
select source_file, '{' || coalesce(string_agg(to_json(field) || ':' || to_json(k), ',' order by field), '') || '}' column_mapping from (select distinct source_file from c) left join h using (source_file) group by 1""")
def q44_column_mapping(spark, d):
    keys = F.explode(F.json_object_keys("payload")).alias("column")
    columns = table(spark, d, "exam_sheet_row").filter("source_file is not null").select("source_file", keys).distinct()
    resolved = standardize.resolve_by_join(columns, table(spark, d, "header_alias"), ["source_file"])
    return standardize.column_mapping(resolved, ["source_file"]).withColumn("column_mapping", F.to_json("column_mapping"))


@query("""
with c as (select source_file, campus, count(*) n, min(row_index) f from exam_record where campus <> '' group by all),
h as (select *, row_number() over (partition by source_file order by f, campus) place from c),
t as (select campus, sum(n)::bigint n, min((source_file, place)) o from h group by 1)
select row_number() over (order by n desc, o) place, campus, n from t""")
def q45_campus_totals(spark, d):
    return quality.campus_totals(quality.campus_histogram(_records(spark, d), "source_file", "row_index"), "source_file")


@query()
def q46_quality_report(spark, d):
    """The lines of the report over all files; its parts have SQL of their own (q09, q10, q11, q35, q42, q43, q45)."""
    r = _records(spark, d)
    named = [F.struct(F.lit(c).alias("column"), F.lit("int" if f == "count" else "str").alias("kind"), F.col(f).cast("string").alias("value")) for c, f in _BOOK_COLUMNS[0].items()]
    return report.quality_report(r.select("source_file", "row_index", F.array(*named).alias("cells")), r, "source_file", "row_index", "2026-01-01 00:00:00")
