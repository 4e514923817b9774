"""The timetable operators: cleaning, parsing, profiles, search, ingest, calendar, files."""

import hashlib
import io
import json
import zipfile
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra import session
from rostra.functions import ical
from rostra.functions.civil import clock_text, days_from_date, valid_date
from rostra.functions.display import display_date
from rostra.functions.text import clean_text, coerce_count, coerce_number
from rostra.functions.timeparse import beijing_text, parse_time_range
from rostra.operators import calendar, ingest, quality, ranking, report, search, standardize
from rostra.schema import RECORD_SCHEMA
from rostra.sources import html, records, xlsx
from rostra.sources.files import replace_workbooks
from rostra.streaming import poll
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, values, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


# ---------------------------------------------------------------- cells
def test_clean_text(spark):
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    values = [f"{space}a\xa0b{space}", None, "", "\xa0", "​x﻿", "x" * 100_000]
    assert each(spark, values, "string", clean_text) == ["a b", "", "", "", "​x﻿", "x" * 100_000]


def test_counts(spark):
    texts = ["12", " 12 ", "１２", "1_000", "12.0", "12.7", "abc", "", None, "+5", "-3", "_1", "1__0", "1099511627776", "9" * 30, "１_０"]
    assert each(spark, texts, "string", coerce_count) == [12, 12, 12, 1000, 0, 0, 0, 0, 0, 5, -3, 0, 0, 2**40, 0, 10]
    assert each(spark, [12.7, -3.9, None, float("nan"), float("inf"), 1e300, 0.0], "double", coerce_number) == [12, -3, 0, 0, 0, 0, 0]


TIMES = [
    ("2025年11月15日(10:25-12:15)", 110, "2025-11-15T10:25:00+08:00", None), ("第10周周1(2025-11-10) 13:30-15:20", 110, "2025-11-10T13:30:00+08:00", None),
    ("2025年1月5日 8:00至9:50", 110, "2025-01-05T08:00:00+08:00", None), ("2025-11-18 23:00-01:00", -1320, "2025-11-18T23:00:00+08:00", None),
    ("2025-2-30 8:00~9:50", None, None, "Parsing exception"), ("2025-11-18 24:00-25:00", None, None, "Parsing exception"),
    ("2025-11-18 13:30:00-15:20:00", None, None, "Parsing exception"), ("2025年1月5日 8:00－9:50", None, None, "Unrecognized date format"),
    ("2025年1月5日　８:００-９:５０", None, None, "Parsing exception"), ("2025年1月5日\r8:00-9:50", 110, "2025-01-05T08:00:00+08:00", None),
    ("2025年1月5日\n8:00-9:50", None, None, "Unrecognized date format"), ("2025-11-18 00:00:00", None, None, "Unrecognized date format"),
    ("", None, None, "Missing time data"), (None, None, None, "Missing time data"), ("２０２５年１月５日 8:00-9:50", 110, "2025-01-05T08:00:00+08:00", None),
    ("2025-11-18 8:00-9:00 2025年1月5日 8:00-9:50", 110, "2025-01-05T08:00:00+08:00", None), ("0000年1月1日 8:00-9:00", None, None, "Parsing exception"),
    ("x" * 100_000, None, None, "Unrecognized date format"),
]


def test_time_ranges(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TIMES)], "i int, v string")
    out = df.select("i", parse_time_range(F.col("v")).alias("t")).select("i", "t.minutes", beijing_text(F.col("t.start_s")).alias("s"), "t.error", "t.date", "t.end_s").orderBy("i").collect()
    assert [(r.minutes, r.s, r.error) for r in out] == [t[1:] for t in TIMES]
    assert all((r.date is None) == (r.end_s is None) == (r.s is None) for r in out)


@settings(max_examples=25, deadline=None)
@given(st.dates())
def test_day_numbers(spark, date):
    y, m, d = F.lit(date.year), F.lit(date.month), F.lit(date.day)
    got = one(spark, F.struct(days_from_date(y, m, d), valid_date(y, m, d), clock_text(days_from_date(y, m, d) * 86400 + 3661)))
    assert (got[0], got[1], got[2]) == ((date - type(date)(1970, 1, 1)).days, True, f"{date.isoformat()}T01:01:01")


# ---------------------------------------------------------------- records and their quality
def test_standardize(spark):
    a = spark.createDataFrame([("f", 2, "北", "K1", "K2", 12.9, "2025-11-18 8:00-9:00")], "source_file string, row_index int, `校区` string, `班级` string, `班级名称` string, `人数` double, `时间` string")
    b = spark.createDataFrame([("g", 2, "\xa0南", None)], "source_file string, row_index int, `校区名称` string, `考试时间` string")
    assert standardize.resolve_aliases(a.columns)["class_name"] == "班级名称"
    out = standardize.standardize([a.withColumn("人数", F.col("人数").cast("string")), b], ["source_file", "row_index"])
    got = rows(out.select("source_file", "campus", "class_name", "count", "duration_minutes", "date", "parse_error"))
    assert got == [("f", "北", "K2", 0, 60, "2025-11-18", None), ("g", "南", "", 0, 0, None, "Missing time data")]
    assert standardize.to_records(standardize.rename_to_standard(a, ["row_index"])).first()["count"] == 12
    numbered = standardize.number_rows(spark.createDataFrame([("f", 5), ("f", 3), ("g", 1)], "f string, pos int"), "f", ["pos"])
    assert rows(numbered.select("row_id", "pos")) == [("f-2", 3), ("f-3", 5), ("g-2", 1)]
    with pytest.raises(ValueError):
        standardize.standardize([], [])
    columns = spark.createDataFrame([("f", "班级"), ("f", "班级名称"), ("g", "x")], "source_file string, column string")
    alias = spark.createDataFrame([("class_name", 1, "班级名称"), ("class_name", 2, "班级"), ("count", 1, "人数")], "field string, alias_pos int, alias string")
    assert rows(standardize.resolve_by_join(columns, alias, ["source_file"], ["class_name", "count"])) == [
        ("f", "class_name", "班级名称", True), ("f", "count", None, False), ("g", "class_name", None, False), ("g", "count", None, False),
    ]


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (2, "a|" + "x" * 40), (3, "b")], "n int, s string")
    assert rows(quality.column_profile(df, ["n", "s"])) == [("n", "int64", 4, 0, 100.0, 3), ("s", "object", 3, 1, 75.0, 2)]
    assert rows(quality.column_profile(df.limit(0), ["n"])) == [("n", "int64", 0, 0, 0.0, 0)]
    assert rows(quality.first_values(df, ["n", "s"], [F.col("n")], 2)) == [("n", "1, 2"), ("s", "b, a|" + "x" * 28)]


def _rec(spark, data):
    return spark.createDataFrame(
        [(f"i{k}", f, k, c, cl, co, d, m, e, "raw") for k, (f, c, cl, co, d, m, e) in enumerate(data)],
        "id string, source_file string, row_index int, campus string, class_name string, course_name string, date string, duration_minutes int, parse_error string, raw_time string",
    )


def test_statistics(spark):
    r = _rec(spark, [("f", "N", "A", "X", "2025-01-02", 110, None), ("f", "S", "", "X", "2025-01-01", 111, None), ("f", "N", None, "", None, 0, "bad"), ("g", "", "A", "Y", "2025-01-02", -5, None)])
    stats = quality.file_statistics(r, "source_file")
    assert rows(stats.select("source_file", "n_rows", "parsed", "failed", "classes", "courses", "avg_minutes", "date_range", "has_errors")) == [
        ("f", 3, 2, 1, 1, 1, 110.5, "2025-01-01 ~ 2025-01-02", True), ("g", 1, 1, 0, 1, 1, 0.0, "2025-01-02 ~ 2025-01-02", False),
    ]
    assert rows(quality.overall_statistics(stats)) == [(2, 4, 3, 1, 2, 2, "2025-01-01 ~ 2025-01-02", "3/4 (75.0%)")]
    assert quality.overall_statistics(stats.filter("source_file = 'g'")).first()["date_range"] == "N/A"
    assert quality.overall_statistics(stats.limit(0)).first()["success"] == "0/0 (0.0%)"
    assert rows(quality.campus_histogram(r, "source_file", "row_index")) == [("f", "N", 2, 1), ("f", "S", 1, 2)]
    many = _rec(spark, [("f", "", "", "", None, 0, "bad")] * 12)
    out = rows(quality.first_errors(many, "source_file", "row_index"))
    assert len(out) == 10 and out[0][2:] == ("Row 0: bad (Raw: 'raw')", 2)


def test_numbered_rows_of_hot_groups(spark):
    data = [("hot" if i % 3 else None if i % 7 == 0 else f"g{i % 11}", i * 7919 % 1009, "x") for i in range(4000)]
    df = spark.createDataFrame(data, "g string, o int, _n string")
    expected, seen = [], {}
    for g, o, x in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        seen[g] = seen.get(g, 4) + 1
        expected.append((g, o, x, seen[g]))
    for n in ("1", "4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = ranking.numbered(df, ["g"], ["o"], "no", start=5).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    assert ranking.numbered(df.limit(0), ["g"], ["o"], "no").count() == 0


def test_skew_safe_join(spark):
    data = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 700).alias("k"))
    groups = data.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = session.skew_safe_join(data, groups, ["k"], "n", "id", 5000, hot_rows=50)
    assert rows(out.select("id", "first")) == rows(data.join(groups, "k").select("id", "first"))


def test_checked_broadcasts(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan(session.broadcast_if_small(spark.range(5), 5))
    assert "ResolvedHint" not in plan(session.broadcast_if_small(spark.range(6), 5))


def test_checkpoints(spark):
    def session_with(master, named=None, made=None):
        known, folder = SimpleNamespace(isDefined=lambda: False), []
        sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)), getConf=lambda: {"spark.checkpoint.dir": named} if named else {}, master=master, setCheckpointDir=folder.append)
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
        return folder

    assert session_with("spark://host:7077", "/shared") == session_with("local[4]", "/shared") == ["/shared"]
    assert len(session_with("local[4]")) == len(session_with("local")) == 1
    for cluster in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session_with(cluster)
    df = session.checkpointed(spark.range(10))
    assert df.count() == 10
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    session.drop_checkpoints(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)) == 0
    assert session.checkpointed(spark.range(3)).count() == 3


# ---------------------------------------------------------------- search and selection
def test_search(spark):
    names = ["A1", "a2", "B1", "", None] + [f"Z{i:03d}" for i in range(60)]
    r = spark.createDataFrame([(f"i{i}", n, f"t{i}" if i else None) for i, n in enumerate(names)], "id string, class_name string, start_timestamp string")
    terms = [("  ", None), ("a", None), ("A2", None), (" a1", None), ("zz", None), ("xx", "B1"), ("xx", "none"), ("x", "B1")]
    out = {(t.term, t.chosen): (t.mode, t.classes, t.exams) for t in search.search_modes(r, spark.createDataFrame(terms, "term string, chosen string")).collect()}
    assert rows(search.search_modes(r, spark.createDataFrame([(None, "A1"), (None, None), ("a2", None), ("a2", None), ("\ufeffz01", None)], "term string, chosen string"))) == [
        (None, None, "EMPTY", 0, None), (None, "A1", "EMPTY", 0, None), ("a2", None, "DETAIL", 1, 1), ("a2", None, "DETAIL", 1, 1), ("\ufeffz01", None, "LIST", 10, None),
    ]
    assert rows(search.search_modes(r.limit(0), spark.createDataFrame([("  ", None), ("xx", "B")], "term string, chosen string")).select("mode", "classes")) == [("DETAIL", 0), ("NOT_FOUND", 0)]
    assert out == {
        ("  ", None): ("LIST", 63, None), ("a", None): ("EMPTY", 0, None), ("A2", None): ("DETAIL", 1, 1), (" a1", None): ("DETAIL", 1, 1),
        ("zz", None): ("NOT_FOUND", 0, None), ("xx", "B1"): ("DETAIL", 1, 1), ("xx", "none"): ("DETAIL", 0, 0), ("x", "B1"): ("EMPTY", 0, None),
    }
    listed = search.listed_classes(r, "z0").collect()
    assert len(listed) == 50 and listed[0]["more"] == 10 and search.listed_classes(r, "z").count() == 0
    assert rows(search.selected(r, spark.createDataFrame([("i0",), ("i1",), ("i1",)], "id string")).select("id")) == [("i1",)]
    assert [x.id for x in search.in_time_order(r.limit(3), "id").collect()] == ["i1", "i2", "i0"]
    assert one(spark, search.share_class(search.share_url("https://example.org/", F.lit("星 A+1")))) == "星 A+1"
    assert one(spark, search.share_class(F.lit("https://example.org/?x=1"))) is None
    dropped = spark.createDataFrame([("i0",), ("i9",)], "id string")
    assert rows(search.selection_state(r, "A1", dropped)) == [(0, 1)] and rows(search.selection_state(r, "a2", dropped)) == [(1, 1)]


def test_cards(spark):
    stamps = ["2026-06-07T23:30:00Z", "2026-06-01T08:05:00+08:00", None, "", "x"]
    assert each(spark, stamps, "string", display_date) == ["6月8日周一 07:30", "6月1日周一 08:05", "", "", ""]
    r = spark.createDataFrame([("a", 1, "", None, "T", None, None, None), ("b", 2, "K", "R", "", "8:00", 0, None)], "id string, row_index int, course_code string, location string, teacher string, raw_time string, count int, start_timestamp string")
    got = rows(search.cards(r, r.filter("id = 'a'").select("id")))
    assert got == [("a", 1, "No Code", "地点待定", "T", "未发布", "-", "", True), ("b", 2, "K", "R", "未知", "8:00", "0", "", False)]


# ---------------------------------------------------------------- notices and files
def test_titles_and_files(spark):
    good = "2025-2026学年第一学期期末考试安排表"
    assert each(spark, [good, "补考" + good, "学年期末考试", "学年学期", None, ""], "string", ingest.is_schedule_title) == [True, False, False, False, False, False]
    files = spark.createDataFrame([(1, "学生版.xlsx"), (1, "监考.xlsx"), (1, "x.xlsx"), (2, "教师.xlsx"), (2, "y.xls"), (3, "巡考.xls")], "page int, name string")
    assert rows(ingest.chosen_attachments(files, "page")) == [(1, "学生版.xlsx"), (2, "y.xls")]
    assert rows(ingest.fetch_summary(spark.createDataFrame([(True,), (None,), (False,)], "ok boolean"))) == [(1, 2, True)]
    notices = spark.createDataFrame([(3, good), (2, good + "2"), (1, "x")], "pos int, title string")
    assert ingest.newest_notice(notices).first()["pos"] == 2


def test_urls(spark):
    base = "https://example.org/a/b/list.htm?p=1#x"
    cases = {
        "https://x.org/f.xls": "https://x.org/f.xls", "//x.org/f": "https://x.org/f", "/f.xls": "https://example.org/f.xls", "f.xls": "https://example.org/a/b/f.xls",
        "./f.xls": "https://example.org/a/b/f.xls", "../f.xls": "https://example.org/a/f.xls", "../../f": "https://example.org/f", "../../../f": "https://example.org/f",
        "a/../b.xlsx": "https://example.org/a/b/b.xlsx", "x/./y.xlsx": "https://example.org/a/b/x/y.xlsx", "/a/../b.xlsx": "https://example.org/b.xlsx",
        "../x/../y.xlsx": "https://example.org/a/y.xlsx", "./../z.xls": "https://example.org/a/z.xls", "x/..": "https://example.org/a/b/", "/../../z": "https://example.org/z",
        "x//y/../z?u=../v#../w": "https://example.org/a/b/x/z?u=../v#../w", "": base, "..": "https://example.org/a/", "x.y/.../..z": "https://example.org/a/b/x.y/.../..z",
        "?q=2": "https://example.org/a/b/list.htm?q=2", "#y": "https://example.org/a/b/list.htm?p=1#y", "mailto:a@x": "mailto:a@x",
    }
    from urllib.parse import urljoin

    assert each(spark, list(cases), "string", lambda c: ingest.absolute_url(base, c)) == list(cases.values()) == [urljoin(base, h) for h in cases]
    assert each(spark, [None], "string", lambda c: ingest.absolute_url(base, c)) == [None]
    for other in ("https://example.org", "https://example.org/", "https://example.org/a/b/", "https://example.org/x?y=/z"):
        assert each(spark, [h for h in cases if h[:1] not in "?#"], "string", lambda c, o=other: ingest.absolute_url(o, c)) == [urljoin(other, h) for h in cases if h[:1] not in "?#"]
    assert each(spark, ["a.XLSX", "a.xls?x=1", None, "b.xls"], "string", ingest.is_workbook_link) == [True, False, False, True]
    assert one(spark, ingest.attachment_name(F.lit("see"), F.lit("/d/a*b.xlsx"))) == "ab.xlsx"
    assert one(spark, ingest.attachment_name(F.lit('x:"y.xls'), F.lit("/d/a.xlsx"))) == "xy.xls"
    assert one(spark, ingest.notice_title(F.lit(""), F.lit(" t "))) == "t"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "..", ".", "b.xls", "", "...", "c?d=..", "e#/../f"]), min_size=1, max_size=6).map("/".join), min_size=20, max_size=40))
def test_urls_agree_with_the_standard_library(spark, references):
    from urllib.parse import urljoin

    base = "https://example.org/p/q/list.htm?x=1#y"
    references = [r for r in references if not r.startswith("//")]
    assert each(spark, references, "string", lambda c: ingest.absolute_url(base, c)) == [urljoin(base, r) for r in references]


def test_links(spark):
    page = '<div class="col_news_con"><ul><li class="news"><span class="news_title"><a href="n.htm" title="T">t <b>x</b></a></span></li></ul></div><p><br><a href=\'f.xls\'> F &amp; G</a><a>no</a>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert [tuple(r) for r in html.parse_links(pages, "page_id").orderBy("pos").collect()] == [
        (1, 0, "n.htm", "T", "t x", True, True, 1), (1, 1, "f.xls", None, "F & G", False, False, None), (1, 2, None, None, "no", False, False, None),
    ]
    items = ['<li class="news"><a href="early"></a><span class="news_title"><a href="t">T</a><a href="t2"></a></span></li>', '<li class="news"><a href="only">O</a><a href="second">x</a></li>', '<li class="news">none</li>', '<li class="other"><a href="no"></a></li>']
    listed = spark.createDataFrame([(1, '<div class="x col_news_con">' + "".join(items) + "</div>" + items[0]), (2, None)], "page_id int, html string")
    assert rows(html.notices(listed, "page_id")) == [(1, 1, "t", None, "T"), (1, 2, "only", None, "O")]
    assert [tuple(a) for a in pages.select(html.anchors(F.col("html")).alias("a")).first()["a"]] == [("n.htm", "t x")]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "name string, digest string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "name string, digest string")
    assert rows(ingest.file_changes(old, new)) == [("a", "removed"), ("b", "changed"), ("c", "same"), ("d", "added")]
    assert ingest.unchanged(old, old.orderBy(F.desc("name")), ["name"]) and not ingest.unchanged(old, old.unionAll(old), ["name"])
    assert not ingest.unchanged(old, new.limit(0), ["name"]) and ingest.unchanged(old.limit(0), new.limit(0), ["name"])
    a, b = (spark.createDataFrame([(i, v) for i, v in enumerate(x)], "n int, v string") for x in ("xy", "yx"))
    assert not ingest.unchanged(a, b, ["n"]) and ingest.unchanged(a, b, ["n"], strict=False)


# ---------------------------------------------------------------- calendar
def _fold(line):
    out, cur, room = [], b"", 75
    for c in line:
        e = c.encode()
        if len(cur) + len(e) > room:
            out.append(cur)
            cur, room = b"", 74
        cur += e
    return "\r\n ".join(x.decode() for x in [*out, cur])


def test_fold(spark):
    lines = ["", "a" * 75, "a" * 76, "a" * 300, "考" * 25, "考" * 26, "a" + "考" * 60, "🎓" * 40, "a" * 74 + "考" + "b" * 80]
    got = each(spark, lines, "string", ical.fold)
    assert got == [_fold(x) for x in lines]
    for x, y in zip(lines, got, strict=True):
        assert y.replace("\r\n ", "") == x and all(len(p.encode()) <= 75 for p in y.split("\r\n"))


def test_uid_and_escape(spark):
    def h(s):
        n = 0
        u = s.encode("utf-16-le")
        for i in range(0, len(u), 2):
            n = (n * 31 + int.from_bytes(u[i : i + 2], "little")) & 0xFFFFFFFF
        n = abs(n - 2**32 if n >= 2**31 else n)
        out = ""
        while n:
            n, r = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out or "0"

    ids = ["a.xlsx-2", "考试🎓", "", "polygenelubricants"]
    assert each(spark, ids, "string", lambda c: ical.uid(c, F.lit(7), "example.org")) == [f"exam-{h(x)}-7@example.org" for x in ids]
    assert one(spark, ical.escape(F.lit("a\\b,c;d\ne"))) == "a\\\\b\\,c\\;d\\ne"
    assert each(spark, ["2026-06-01T08:00:00+08:00", "2026-06-01T08:00:00.5Z", "", None], "string", ical.calendar_stamp) == ["20260601T080000", "20260601T080000", None, None]
    assert [one(spark, ical.toggle(F.array(*map(F.lit, a)), F.lit(2))) for a in ([1], [1, 2])] == [[1, 2], [1]]
    assert tuple(one(spark, ical.elapsed(F.lit(90061)))) == (1, 1, 1, 1)


EXAM = "id string, campus string, course_name string, course_code string, class_name string, teacher string, location string, count int, notes string, start_timestamp string, end_timestamp string"


def test_calendar(spark, tmp_path):
    s, e = "2026-06-01T08:00:00+08:00", "2026-06-01T09:50:00+08:00"
    exams = spark.createDataFrame([("b", "", "M,1", "", "A", None, "R", 3, "", s, None), ("c", "N", "P", "K", "A", "T", "R;1", None, "x", s, e), ("a", "", "E", "K", "A", "T", "", 1, None, None, e)], EXAM)
    text = calendar.calendar_text(exams, "cal", "20260101T000000Z", reminders=[30])
    lines = text.replace("\r\n ", "").split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-1] == "END:VCALENDAR" and lines.count("BEGIN:VEVENT") == 1 and not text.endswith("\r\n")
    start = lines.index("BEGIN:VEVENT")
    assert lines[start + 1].endswith("-1@example.org") and lines[start + 3 : start + 8] == [
        "DTSTART;TZID=Asia/Shanghai:20260601T080000", "DTEND;TZID=Asia/Shanghai:20260601T095000", "SUMMARY:考试: P", "LOCATION:[N] R\\;1",
        "DESCRIPTION:课程代码: K\\n教师: T\\n班级: A\\n人数: 0\\n备注: x\\nGenerated by rostra",
    ]
    assert lines[start + 9 : start + 14] == ["BEGIN:VALARM", "ACTION:DISPLAY", "DESCRIPTION:Exam Reminder", "TRIGGER:-PT30M", "END:VALARM"]
    with pytest.raises(ValueError):
        calendar.calendar_text(exams.limit(0), "cal", "x")
    several = exams.withColumn("c", F.lit("A/1")).unionAll(exams.limit(1).withColumn("c", F.lit("B"))).unionAll(exams.limit(1).withColumn("c", F.lit(None).cast("string")))
    done = rows(calendar.write_calendars(several, "c", str(tmp_path / "cal"), "20260101T000000Z", reminders=[30]))
    assert done == [("A/1", "exams_A1.ics", len(text.split("\r\n")) - text.count("\r\n ")), ("B", "exams_B.ics", 17)]
    read = lambda name: open(tmp_path / "cal" / name, encoding="utf8", newline="").read()
    assert read("exams_A1.ics") == text.replace("X-WR-CALNAME:cal", "X-WR-CALNAME:A/1") and "VEVENT" not in read("exams_B.ics")
    assert calendar.calendar_lines(several.limit(0), "c", "x").count() == 0
    assert rows(calendar.reminders_of(exams.filter("id = 'c'"), [60, 30, 30]).select("minutes")) == [(30,), (60,)]


# ---------------------------------------------------------------- files
def _workbook(path, rows_xml, shared=(), styles=""):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/m/d"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows_xml}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    _workbook(
        tmp_path / "b b+.xlsx",
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>时间</t></is></c><c r="E1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>12</v></c><c r="D2" s="1"><v>45992.5</v></c></row><row r="3"><c r="A3"/></row>'
        '<row r="5"><c r="A5" t="inlineStr"><is><t>N/A</t></is></c><c r="B5"><v>1.5</v></c><c r="D5" t="b"><v>1</v></c></row>',
        ["班级", "人数", "A&amp;B"],
    )
    _workbook(tmp_path / "a.xlsx", '<row r="1"><c r="A1" t="inlineStr"><is><t>人数</t></is></c></row>')
    _workbook(tmp_path / "late.xlsx", '<row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>99</v></c></row>')  # damaged below its first rows
    (tmp_path / "cut.xlsx").write_bytes((tmp_path / "a.xlsx").read_bytes()[:80])
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    book = xlsx.read_workbooks(xlsx.workbook_files(spark, str(tmp_path)))
    assert rows(book.filter("part = 'header'").select("source_file", "cells.column")) == [("a.xlsx", ["人数"]), ("b b+.xlsx", ["班级", "人数", "Unnamed: 2", "时间", "班级.1"])]
    cells = rows(book.filter("part = 'row'").select("source_file", "row_index", "cells.value", "cells.kind"))
    assert cells == [
        ("b b+.xlsx", 2, ["A&B", "12", None, "2025-12-01 12:00:00", None], ["str", "int", None, "date", None]), ("b b+.xlsx", 5, [None, "1.5", None, "True", None], [None, "float", None, "bool", None]),
    ]
    assert {r.source_file: r.error.split(":")[0] for r in xlsx.failed_files(book).collect()} == {"cut.xlsx": "BadZipFile", "late.xlsx": "IndexError"}
    out = standardize.to_records(xlsx.standard_rows(book))
    assert rows(out.select("source_file", "class_name", "count", "parse_error")) == [("b b+.xlsx", "", 0, "Unrecognized date format"), ("b b+.xlsx", "A&B", 12, "Unrecognized date format")]
    both = xlsx.workbook_files(spark, str(tmp_path), "*.{xls,xlsx}")
    assert dict(map(tuple, xlsx.workbook_digests(both).collect()))["old.xls"] == hashlib.md5(b"\xd0\xcf\x11\xe0").hexdigest() and both.count() == 5
    nothing = spark.createDataFrame([(None, None), ("/x/n.xlsx", None), ("/x/o.xlsx", bytearray())], "path string, content binary")
    assert rows(xlsx.failed_files(xlsx.read_workbooks(nothing))) == [(None, "ValueError: no content"), ("n.xlsx", "ValueError: no content"), ("o.xlsx", "BadZipFile: File is not a zip file")]
    assert xlsx.read_workbooks(nothing.limit(0)).count() == 0


def test_large_workbooks_are_whole_or_nothing(spark, monkeypatch):
    monkeypatch.setattr(xlsx, "_BUFFERED_BYTES", 0)
    good = xlsx.workbook_bytes(["班级", "x"], [[f"K{i}", None if i % 2 else i] for i in range(5000)])
    _late = io.BytesIO()
    _workbook(_late, '<row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>99</v></c></row>')
    book = xlsx.read_workbooks(spark.createDataFrame([("g.xlsx", bytearray(good)), ("bad.xlsx", bytearray(_late.getvalue()))], "path string, content binary"))
    assert rows(book.groupBy("source_file", "part").count()) == [("bad.xlsx", "error", 1), ("g.xlsx", "header", 1), ("g.xlsx", "row", 5000)]
    text = 'a<b>&"\r\n\t中\U0001f393\x01'
    one = [*xlsx.Workbook(xlsx.workbook_bytes(["h"], [[text], [True], [1.5]])).rows()]
    assert [c[0] for _, c in one] == [("str", "h"), ("str", text[:-1]), ("bool", "True"), ("float", "1.5")]


def test_replacing_workbooks(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "old.xls").write_bytes(b"o")
    files = spark.createDataFrame([("n.xlsx", bytearray(b"new")), ("m.xls", bytearray(b""))], "name string, content binary")
    assert replace_workbooks(spark, files, str(folder)) == 2
    assert {f.name: f.read_bytes() for f in folder.iterdir() if not f.name.startswith(".")} == {"n.xlsx": b"new", "m.xls": b""}
    with pytest.raises(ValueError):
        replace_workbooks(spark, files.limit(0), str(folder))
    assert (folder / "n.xlsx").exists()


def test_sheet_profile(spark):
    cell = "array<struct<column:string,kind:string,value:string>>"
    data = [
        ("f", 2, [("n", "int", "1"), ("s", "str", "b"), ("d", "date", "2026-01-01 00:00:00"), ("e", None, None)]),
        ("f", 3, [("n", "int", "2"), ("s", "int", "5"), ("d", None, None), ("e", None, None), ("late", "bool", "True")]),
        ("f", 3, [("n", "int", "2"), ("s", "str", "a|\n" + "x" * 40)]), ("g", 2, [("n", "int", "1")]), ("g", 3, []), ("g", 4, None), (None, 2, [("n", "float", "1.5")]),
    ]
    df = spark.createDataFrame(data, f"file string, r int, cells {cell}").withColumn("column", F.lit("clash"))
    assert rows(quality.sheet_profile(df, "file", "r")) == [
        (None, "n", 1, "float64", 1, 0, 100.0, 1, "1.5"), ("f", "d", 3, "datetime64[ns]", 1, 2, 33.3, 1, "2026-01-01 00:00:00"), ("f", "e", 4, "float64", 0, 3, 0.0, 0, None),
        ("f", "late", 5, "object", 1, 2, 33.3, 1, "True"), ("f", "n", 1, "int64", 3, 0, 100.0, 2, "1, 2"), ("f", "s", 2, "object", 3, 0, 100.0, 3, "b, 5, a|\n" + "x" * 27),
        ("g", "n", 1, "float64", 1, 2, 33.3, 1, "1"),
    ]
    raw = quality.raw_samples(df.filter("file = 'f'"), "file", "r")
    assert [r.value for r in raw.filter("pos < 3").orderBy("place", "pos").collect()] == ["1", "b", "2026-01-01T00:00:00", "2", "5", None, "2", "a/ " + "x" * 17]
    assert quality.sheet_profile(df.limit(0), "file", "r").count() == quality.raw_samples(df.limit(0), "file", "r").count() == 0
    payload = ['{"a":1,"b":1.5,"c":"x","d":true,"e":null,"f":{"z":1,"y":[2]}}', "[1]", "bad", None]
    got = each(spark, payload, "string", records.json_cells)
    assert [tuple(c) for c in got[0]] == [("a", "int", "1"), ("b", "float", "1.5"), ("c", "str", "x"), ("d", "bool", "true"), ("e", None, None), ("f", "object", '{"y":[2],"z":1}')]
    assert got[1:] == [None] * 3
    columns = spark.createDataFrame([("f", "班级"), ("g", "x")], "file string, column string")
    alias = spark.createDataFrame([("class_name", 1, "班级名称"), ("class_name", 2, "班级")], "field string, alias_pos int, alias string")
    assert rows(standardize.column_mapping(standardize.resolve_by_join(columns, alias, ["file"]), ["file"])) == [("f", {"class_name": "班级"}), ("g", {})]
    histogram = spark.createDataFrame([("g", "N", 2, 1), ("f", "S", 1, 2), ("f", "N", 1, 1), ("g", "S", 2, 2), ("g", "X", 9, 3)], "file string, campus string, n bigint, place int")
    assert rows(quality.campus_totals(histogram, "file")) == [(1, "X", 9), (2, "N", 3), (3, "S", 3)]


def test_dataset_and_manifest(spark, tmp_path):
    values = {f.name: None for f in RECORD_SCHEMA} | {"id": "f-2", "class_name": "考", "count": 1, "campus": 'a"b'}
    df = spark.createDataFrame([tuple(values.values())], RECORD_SCHEMA)
    assert json.loads(report.dataset_array(df, ["id"])) == [values]
    path = str(tmp_path / "data")
    assert report.write_dataset(df, path, ["id"]) and not report.write_dataset(df, path, ["id"])
    assert report.write_dataset(df.withColumn("count", F.lit(2)), path, ["id"]) and records.read_dataset(spark, path).first()["count"] == 2
    with pytest.raises(ValueError):
        report.write_dataset(df.limit(0), path, ["id"])
    (tmp_path / "m.json").write_text('{"source_url": "", "source_title": "t"}')
    source = records.source_of(records.read_optional(spark, str(tmp_path / "m.json"), records.SOURCE))
    made = report.manifest(df.withColumn("f", F.lit("f")), "f", "now", source).first()
    assert (made.files_processed, made.total_records, made.source_url, made.source_title) == (["f"], 1, None, "t")
    assert records.read_optional(spark, str(tmp_path / "none.json"), records.MANIFEST).count() == 0
    assert records.read_newest(spark, [str(tmp_path / "none"), path]).count() == 1
    with pytest.raises(FileNotFoundError):
        records.read_newest(spark, [str(tmp_path / "none")])
    report.write_metadata(str(tmp_path / "s.json"), "u", "t", ["f"], "now")
    assert records.read_optional(spark, str(tmp_path / "s.json"), records.SOURCE).first()["downloaded_files"] == ["f"]


def test_report(spark, tmp_path):
    cells = "array<struct<column:string,kind:string,value:string>>"
    sheets = spark.createDataFrame([
        ("f", 2, [("校区", "str", "N"), ("人数", "int", "3")]), ("f", 3, [("校区", "str", "S|\n"), ("人数", None, None)]), ("g", 2, [("地点", "str", "R")]), (None, 2, []),
    ], f"file string, row_no int, cells {cells}")
    data = [("f", 2, "N", "A", 110, None, "2026-01-01"), *[("f", i, "S", "A", 0, "bad", None) for i in range(3, 15)], ("g", 2, "", "", 0, None, None)]
    r = spark.createDataFrame(
        [(*x, "C", "R", "T", 1, None, "raw") for x in data],
        "file string, row_no int, campus string, class_name string, duration_minutes int, parse_error string, date string, course_name string, location string, teacher string, count int, start_timestamp string, raw_time string",
    )
    lines = report.quality_report(sheets, r, "file", "row_no", "2026-01-01 00:00:00")
    report.write_report(lines, str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text(encoding="utf8").split("\n")
    assert text[:2] == ["# Data inventory and quality", ""] and "| Records | 14 |" in text and "| Campuses | S (12), N (1) |" in text
    f, g = text.index("## ⚠️ `f`"), text.index("## ✅ `g`")
    assert f < g and text[f + 2] == "Rows 13, columns 2, parsed 1/13, dates 2026-01-01 ~ 2026-01-01"
    mine, other = text[f:g], text[g:]
    assert "| 2 | `人数` | float64 | 50.0 | 1 | 3 |" in mine and not any("人数" in x and "tried" not in x for x in other)
    assert "| `campus` | `校区` | mapped |" in mine and "| `campus` | _(tried: 校区, 校区名称)_ | not found |" in other and "| `location` | `地点` | mapped |" in other
    assert "12 rows with parsing issues:" in mine and "- Row 3: bad (Raw: 'raw')" in mine and "- _and 2 more_" in mine
    assert mine[mine.index("| 校区 | 人数 |") :][:4] == ["| 校区 | 人数 |", "| --- | --- |", "| N | 3 |", "| S/  |  |"]
    assert sum(x.startswith("| A | C |") for x in mine) == 3 and "- Row" not in "".join(other)
    assert report.quality_report(sheets.limit(0), r.limit(0), "file", "row_no", "x").filter("file is not null").count() == 0


def test_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "source_file string, row_index int, `班级` string, `时间` string").schema
    (tmp_path / "in").mkdir()

    def run():
        poll.poll_folder(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["source_file", "row_index"]).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")).select("class_name", "duration_minutes"))

    (tmp_path / "in/1.json").write_text('{"source_file":"f","row_index":2,"班级":" A","时间":"2025-1-5 8:00-9:00"}\n', encoding="utf8")
    assert run() == [("A", 60)]
    (tmp_path / "in/2.json").write_text('{"source_file":"g","row_index":2,"班级":"B"}\n', encoding="utf8")
    assert run() == [("A", 60), ("B", 0)] == run()
