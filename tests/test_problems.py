"""The general problems: edge cases, and brute force over whole tables."""

import csv
import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra.operators import badrows, drift, intervals, packed, snapshots, timestamps
from rostra.session import table
from tests.conftest import rows

# ---------------------------------------------------------------- 1: snapshots
SNAP = "snapshot_no int, id string, location string, start_timestamp string, ingested_at timestamp_ntz, state string, ord int"


def _snap(spark, data):
    t = datetime(2026, 1, 1)
    full = [(s, i, loc, start, t + timedelta(minutes=m) if m is not None else None, "x", 9) for s, i, loc, start, m in data]
    return spark.createDataFrame(full, SNAP)


def _changes(df):
    return rows(snapshots.snapshot_changes(df, snapshots.exam_state(df)))


def test_snapshot_changes(spark):
    a, b = "2026-06-01T08:00:00+08:00", "2026-06-01T00:00:00Z"
    df = _snap(spark, [
        (3, "kept", "R1", a, 1), (5, "kept", "\xa0R1 ", b, 1), (9, "kept", "R1", a, 1),  # the same instant and text
        (3, "gone", None, None, 1), (5, "gone", "", None, 1),  # null equals empty
        (5, "new", "R", a, 1), (9, "new", "Q", a, 1),
        (3, "back", "R", a, 1), (9, "back", "R", a, 1),
        (3, "twice", "old", a, 1), (3, "twice", "new", a, 2), (5, "twice", "new", a, 0), (9, "twice", "new", None, None),
        (5, None, "R", a, 1), (None, "x", "R", a, 1),
    ])
    assert _changes(df) == [
        (5, "back", "removed"), (5, "new", "added"), (9, "back", "added"), (9, "gone", "removed"), (9, "new", "changed"), (9, "twice", "changed"),
    ]


def test_snapshot_changes_of_nothing(spark):
    assert _changes(_snap(spark, [])) == []
    assert _changes(_snap(spark, [(1, "a", "R", None, 1)])) == []


def test_validity_intervals(spark):
    a = None
    df = _snap(spark, [(1, "x", "R", a, 1), (2, "x", "R", a, 1), (4, "x", "Q", a, 1), (7, "y", "R", a, 1), (7, "y", "R", a, 1)])
    found, ordinals = snapshots.validity_intervals(df, snapshots.exam_state(df))
    assert rows(found.select("id", "first_ord", "last_ord")) == [("x", 1, 2), ("x", 3, 3), ("y", 4, 4)]
    assert rows(ordinals) == [(1, 1), (2, 2), (3, 4), (4, 7)]


# ---------------------------------------------------------------- 2: rows that fail to parse
def _strict(line):
    """(well quoted, fields) by a plain character automaton."""
    line = (line or "").removesuffix("\r")
    fields, cur, state = [], "", "start"
    for c in line:
        if state == "quoted":
            state, cur = ("closed", cur) if c == '"' else (state, cur + c)
        elif state == "closed" and c == '"':
            state, cur = "quoted", cur + '"'
        elif c == ",":
            fields.append(cur)
            state, cur = "start", ""
        elif c == '"' and state == "start":
            state = "quoted"
        elif c == '"' or state == "closed":
            return False, []
        else:
            state, cur = "plain", cur + c
    return state != "quoted", [*fields, cur]


def _clock(text):
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", text)
    return 0 <= int(m[1]) <= 23 and 0 <= int(m[2]) <= 59


def _reason(line):
    quoted, fields = _strict(line)
    if not quoted:
        return "broken_quoting"
    if len(fields) != 9:
        return "column_count"
    if not re.fullmatch("[0-9０-９]*", fields[6].strip()):
        return "bad_count"
    time = fields[7].replace("\xa0", " ").strip()
    if not time:
        return "missing_time"
    span = r".*?(\d{1,2}:\d{2})\s*[-~至]\s*(\d{1,2}:\d{2})"
    m = re.search(r"(\d{4})年(\d{1,2})月(\d{1,2})日" + span, time) or re.search(r"(\d{4})-(\d{1,2})-(\d{1,2})" + span, time)
    if not m:
        return "unrecognized_time"
    try:
        datetime(int(m[1]), int(m[2]), int(m[3]))
        return None if _clock(m[4]) and _clock(m[5]) else "impossible_time"
    except ValueError:
        return "impossible_time"


def test_reasons_of_a_whole_table(spark, sf_dir):
    t = table(spark, sf_dir.replace("0.001", "0.01"), "exam_raw_line")
    expected = sorted((r.line_id, why) for r in t.filter("line_no > 1").collect() if (why := _reason(r.line)))
    assert sorted(map(tuple, badrows.rejected_lines(t).collect())) == expected
    loaded = badrows.loaded_lines(t)
    assert loaded.count() + len(expected) == t.filter("line_no > 1").select("line_id").distinct().count()
    for r in loaded.select("line_id", "location").limit(200).collect():
        line = t.filter(F.col("line_id") == r.line_id).first().line if r.line_id % 40 == 0 else None
        if line:
            assert next(csv.reader([line.removesuffix("\r")], strict=True))[8].strip() == r.location


def test_reasons(spark):
    time = "2026-06-01 8:00-9:50"
    ok = f"a,b,c,d,e,f,12,{time},r"
    cases = {
        ok: None, ok + "\r": None, f'"a","b""x","c","d,d","e","f"," 12 ","{time}","r\n2"': None, f"a,b,c,d,e,f,,{time},": None,
        f'a,b,c,d,e,f,12,"{time},r': "broken_quoting", f'a,b,c,d,e,"f" ,12,{time},r': "broken_quoting", f'a,b,c,d,e,f"x,12,{time},r': "broken_quoting",
        f'"a\\"b",b,c,d,e,f,12,{time},r': "broken_quoting", "": "column_count", ok + ",": "column_count", "a;b": "column_count", None: "column_count",
        ok.replace("12", "1.5"): "bad_count", ok.replace("12", "\xa0１２ "): None, ok.replace("12", "-1"): "bad_count", ok.replace(time, " \xa0"): "missing_time",
        ok.replace(time, "TBA"): "unrecognized_time", ok.replace(time, "2026-06-01 8:00—9:50"): "unrecognized_time",
        ok.replace(time, "2026-2-30 8:00-9:50"): "impossible_time", ok.replace(time, "2026-06-01 13:30:00-15:20:00"): "impossible_time",
        ok.replace(time, "0000年1月1日 8:00-9:00"): "impossible_time", "x" * 300_000: "column_count", '"' * 30_001: "broken_quoting", '"' + '""' * 20_000 + '",,,,,,,,': "missing_time",
    }
    df = spark.createDataFrame([(i, x, 2, "clash") for i, x in enumerate(cases)], "line_id bigint, line string, line_no int, reason string")
    assert dict(rows(badrows.rejected_lines(df))) == {i: why for i, why in enumerate(cases.values()) if why}
    assert badrows.rejected_lines(df.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='t",', max_size=24))
def test_minimum_cost_parse_agrees_with_the_grammar(shape):
    shape = re.sub("t+", "t", shape)
    quotes, delimiters, operations = badrows.minimum_cost_parse(shape, 4)
    quoted, fields = _strict(shape)
    assert (quotes == 0) == quoted
    if quoted:
        assert delimiters == abs(len(fields) - 4)
    assert bool(operations) == (quotes + delimiters > 0)


# ---------------------------------------------------------------- 3: intervals
def _brute_periods(data):
    """[(entity, kind, start, end)] by a plain sweep."""
    out, by = [], {}
    for e, s, t in set(data):
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, spans in by.items():
        spans.sort()
        start, end, n = *spans[0], 1
        for s, t in spans[1:]:
            if s <= end:
                end, n = max(end, t), n + 1
            else:
                out += [(e, "island", start, end, n), (e, "gap", end, s, 0)]
                start, end, n = s, t, 1
        out.append((e, "island", start, end, n))
    return sorted(out)


def test_busy_periods_across_partitions(spark):
    rnd = random.Random(3)
    data = []
    for k in range(3000):
        e = "hot" if k % 3 else f"e{rnd.randint(0, 20)}"
        s = rnd.randint(0, 60_000)
        data.append((e, s, s + rnd.choice([0, 1, 5, 30, 2000 if rnd.random() < 0.02 else 3])))
    data += [("hot", 10, 50_000)] * 500 + [("long", 0, 10**6)] + [("long", i, i + 1) for i in range(300)]
    data += [(None, 1, 2), ("n", None, 2), ("n", 1, None), ("back", 5, 4), ("", 1, 2)]
    df = spark.createDataFrame(data, "entity string, start_us bigint, end_us bigint")
    for partitions in (1, 7, 40):
        assert rows(intervals.busy_periods(df, partitions)) == sorted(_brute_periods(data), key=lambda r: tuple((True, str(x)) for x in r))
    assert intervals.busy_periods(df.limit(0)).count() == 0


def test_class_periods(spark):
    z = lambda d, h, m=0, zone="+08:00": f"2026-06-{d:02d}T{h:02d}:{m:02d}:00{zone}"
    data = [
        ("A", z(1, 8), z(1, 9)), ("A", z(1, 0, 0, "Z"), z(1, 1, 0, "Z")), ("A", z(1, 9), z(1, 10)), ("A", z(1, 14), z(1, 15)), ("A", z(2, 8), z(2, 9)),
        ("", z(1, 8), z(1, 9)), (None, z(1, 8), z(1, 9)), ("B", "x", z(1, 9)), ("B", z(1, 9), z(1, 8)), ("C", z(1, 8), z(1, 8, 30)), ("C", z(1, 8), z(1, 8, 30)),
    ]
    df = spark.createDataFrame([(*r, 1) for r in data], "class_name string, start_timestamp string, end_timestamp string, kind int")
    assert rows(intervals.class_periods(df)) == [("A", "gap", z(1, 10), z(1, 14)), ("A", "merged", z(1, 8), z(1, 10))]


# ---------------------------------------------------------------- 4: packed values
def _brute_split(text):
    """Character by character, with look-ahead instead of tokens."""
    quotes = {'"': '"', "“": "”", "「": "」"}
    out, cur, i, depth, close, keep = [], "", 0, 0, None, False
    s = text or ""
    while i < len(s):
        c = s[i]
        if close:
            if c == close:
                if c == '"' and not keep and s[i + 1 : i + 2] == '"':
                    cur, i = cur + '"', i + 2
                    continue
                close = None
                cur += c if keep else ""
            else:
                cur += c
        elif depth == 0 and c in quotes:
            keep = bool(cur.strip())
            cur = cur + c if keep else ""
            close = quotes[c]
        elif c in "(（[":
            depth, cur = depth + 1, cur + c
        elif c in ")）]":
            depth, cur = max(0, depth - 1), cur + c
        elif depth:
            cur += c
        elif m := re.compile("[ \xa0]+(?:与|及|and)(?=[ \xa0])|[ \xa0]{2,}|[、，,；;/／|｜&＆\n\r\t\u3000]").match(s, i):
            out.append(cur)
            cur, i = "", m.end()
            continue
        else:
            cur += c
        i += 1
    return [v.strip() for v in [*out, cur] if v.strip()]


def test_packed_values_of_a_whole_table(spark, sf_dir):
    t = table(spark, sf_dir.replace("0.001", "0.01"), "exam_record")
    expected = {(r.id, i, v) for r in t.collect() if len(vs := _brute_split(r.teacher)) > 1 for i, v in enumerate(vs, 1)}
    found = [tuple(r) for r in packed.unpack_values(t, "teacher", ["id"], 2).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_packed_values(spark):
    cases = {
        '"Marta ""Tilly"" Rusk"|王一': ['Marta "Tilly" Rusk', "王一"], "甲 与 「Tor, Cor」": ["甲", "Tor, Cor"], "甲(A,B卷)": ["甲(A,B卷)"],
        "“组; 三” 与  乙": ["组; 三", "乙"], "甲\nAnna Q， 乙\r\n\"J O'V\";丙 and 丁 & 安·维/": ["甲", "Anna Q", "乙", "J O'V", "丙", "丁", "安·维"],
        "甲; ; 乙": ["甲", "乙"], "Anna-Lise A-L": ["Anna-Lise A-L"], 'x "a,b" y, z': ['x "a,b" y', "z"], '""': [], None: [], "": [], " \xa0": [], ",,": [],
        "a  b": ["a", "b"], "a\xa0\xa0b": ["a", "b"], "a\u3000b\tc": ["a", "b", "c"], "甲，甲": ["甲", "甲"], "a and": ["a and"], "and, or": ["and", "or"],
        "（主考": ["（主考"], "a" * 50_000: ["a" * 50_000],
    }
    df = spark.createDataFrame([(str(i), t, 7) for i, t in enumerate(cases)] * 2, "id string, teacher string, pos int")
    expected = [(str(i), k, v) for i, vs in enumerate(cases.values()) for k, v in enumerate(vs, 1)]
    assert rows(packed.unpack_values(df, "teacher", ["id"])) == sorted(expected, key=lambda r: tuple((True, str(x)) for x in r))
    assert packed.unpack_values(df.limit(0), "teacher", ["id"], 2).count() == 0


# ---------------------------------------------------------------- 5: time stamps
_BEIJING = timezone(timedelta(hours=8))


def _local(naive, zone):
    """UTC of a wall clock: the earlier of two instants, later by the gap where it is skipped."""
    a = naive.replace(tzinfo=zone, fold=0)
    return a.astimezone(timezone.utc)


def _zone(text):
    text = text.strip(" ()（）")
    if not text:
        return None
    if text in ("Z", "UTC", "GMT"):
        return timezone.utc
    if text == "北京时间":
        return _BEIJING
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", text)
    if m:
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes))
    return ZoneInfo(text)


_FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S", "%Y.%m.%d %H:%M", "%Y%m%d%H%M%S", "%Y%m%dT%H%M%S",
            "%Y年%m月%d日 %H:%M", "%d %b %Y, %H:%M", "%d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p"]


def _stamp(text, home):
    s = (text or "").strip()
    if re.fullmatch(r"\d{10}", s):
        return datetime.fromtimestamp(int(s), timezone.utc)
    if re.fullmatch(r"\d{13}", s):
        return datetime.fromtimestamp(int(s) // 1000, timezone.utc)
    s = re.sub(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "", re.sub(r"\[.*\]$", "", s))
    zone = home
    m = re.search(r"(?<=:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d|[+-]\d{4})$|(\.\d+)?\s*(北京时间|(?:UTC|GMT)[+-]\d{1,2}(?::\d\d)?| [+-]\d{4}|[A-Z][a-z]+/\w+)$", s)
    if m:
        zone, s = _zone(m[2] or m[4]), s[: m.start()]
    s = re.sub(r"(:\d\d)\.\d+$", r"\1", s.strip())
    half = re.search("上午|下午", s)
    if half:
        s = re.sub(r"(上午|下午)(\d+)", lambda x: f" {int(x[2]) % 12 + (12 if x[1] == '下午' else 0)}", s)
    for f in _FORMATS:
        try:
            naive = datetime.strptime(s, f)
        except ValueError:
            continue
        return _local(naive, zone) if zone else None
    return None


def _range(text, home):
    m = re.search(r"(\d{4})(?:年|-)(\d{1,2})(?:月|-)(\d{1,2}).*?(\d{1,2}):(\d\d)[-~至](\d{1,2}):(\d\d)\)?(.*)$", text or "")
    if not m:
        return None, None
    zone = _zone(m[8]) or home
    try:
        return tuple(_local(datetime(*map(int, m.group(1, 2, 3, a, a + 1))), zone) for a in (4, 6)) if zone else (None, None)
    except ValueError:
        return None, None


def test_times_of_a_whole_table(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    zones = {r.campus: ZoneInfo(r.zone_id) for r in table(spark, d, "campus_zone").collect()}
    expected = []
    for r in table(spark, d, "exam_time_feed").collect():
        home = zones.get(r.campus)
        if (r.start_timestamp or "").strip() or (r.end_timestamp or "").strip():
            lo, hi = _stamp(r.start_timestamp, home), _stamp(r.end_timestamp, home)
        else:
            lo, hi = _range(r.raw_time, home)
        if lo and hi:
            expected.append((r.feed_id, *(x.strftime("%Y-%m-%dT%H:%M:%SZ") for x in (lo, hi))))
    found = timestamps.found_times(table(spark, d, "exam_time_feed"), table(spark, d, "campus_zone"))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_times(spark):
    zones = spark.createDataFrame([("B", "Europe/Berlin"), ("N", "America/New_York"), ("S", "Asia/Shanghai"), ("bad", "Mars/Base")], "campus string, zone_id string")
    ok = "2026-01-01T00:00:00Z"
    cases = [
        ("B", "2026-03-29 02:30:00", "2026-10-25 02:30", None, "2026-03-29T01:30:00Z", "2026-10-25T00:30:00Z"),  # skipped, twice
        ("N", "2026-03-08T02:15:00", ok, None, "2026-03-08T07:15:00Z", ok), (None, "2026-06-01 08:00", ok, None, None, None),
        (None, "2026-06-01 08:00 北京时间", "1780272000999", None, "2026-06-01T00:00:00Z", "2026-06-01T00:00:00Z"), ("bad", "2026-06-01 08:00", ok, None, None, None),
        ("S", "2026年6月1日下午12:30", "2026年6月1日上午12:30", None, "2026-06-01T04:30:00Z", "2026-05-31T16:30:00Z"),
        ("S", "Jun 1, 2026 12:05 AM", "1 June 2026, 12:05", None, "2026-05-31T16:05:00Z", "2026-06-01T04:05:00Z"), ("S", "Jun 1, 2026 13:05 PM", ok, None, None, None),
        ("S", "2026-02-29 08:00", ok, None, None, None), ("S", "2026-06-24 25:10", ok, None, None, None), ("S", ok, None, "2026-06-01 8:00-9:00", None, None),
        ("S", "-", "", "2026-06-01 8:00-9:00", None, None), ("S", "", " \xa0", "2026-06-01 8:00~9:00 (UTC)", "2026-06-01T08:00:00Z", "2026-06-01T09:00:00Z"),
        ("S", None, None, "第1周(2026-06-01) 8:00-9:00（北京时间）", "2026-06-01T00:00:00Z", "2026-06-01T01:00:00Z"), ("S", None, None, "2026年6月1日(8:00-9:00) GMT-5:30", "2026-06-01T13:30:00Z", "2026-06-01T14:30:00Z"),
        ("S", None, None, "2026-06-01 8:00-9:00 CST", None, None), ("S", None, None, "TBA", None, None), ("S", None, None, None, None, None),
        ("S", "2026-06-01T08:00:00.999999999+05:30[Asia/Kolkata]", "20260601080000", None, "2026-06-01T02:30:00Z", "2026-06-01T00:00:00Z"),
        ("S", "2026-06-01 08:00 Mars/Base", ok, None, None, None), ("S", "x" * 100_000, ok, None, None, None), ("S", "2026-06-01 08:00 UTC+19", ok, None, None, None),
        ("S", "2026/06-01 08:00", ok, None, None, None), ("S", "2026-06-01 08:00:60", ok, None, None, None),
    ]
    feed = spark.createDataFrame(
        [(i, c, a, b, r, "x", "y") for i, (c, a, b, r, _, _) in enumerate(cases)],
        "feed_id bigint, campus string, start_timestamp string, end_timestamp string, raw_time string, zone_id string, start_utc string",
    )
    assert dict((r[0], r[1:]) for r in rows(timestamps.found_times(feed, zones))) == {i: c[4:] for i, c in enumerate(cases) if c[4]}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert timestamps.found_times(feed, zones).count() == sum(c[4] is not None for c in cases)
        assert ("S" and rows(timestamps.found_times(feed, zones)))[0][1] == "2026-03-29T01:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert timestamps.found_times(feed.limit(0), zones).count() == 0


# ---------------------------------------------------------------- 6: drifting schemas
def _sheet(spark, data):
    return spark.createDataFrame(
        [(i, s, q, f, i, p, "k") for i, (s, q, f, p) in enumerate(data)],
        "sheet_row_id bigint, series_id int, file_seq int, source_file string, row_index int, payload string, kind string",
    )


ALIAS = [("class_name", 1, "班级名称"), ("class_name", 2, "Class Name"), ("count", 1, "人数"), ("location", 1, "地点")]


def test_schema_changes(spark):
    alias = spark.createDataFrame(ALIAS, "field string, alias_pos int, alias string")
    df = _sheet(spark, [
        (1, 1, "a", '{"班级名称":"x","人数":5,"座位":1}'), (1, 1, "a", '{"班级名称":null,"人数":"6"}'), (1, 1, "a", '{"人数":7}'),
        (1, 4, "b", '{"CLASS_ name":"x","人 数":"5","座位":null,"地点":null}'), (1, 4, "b", '{"Ｃlass\\nName":["y"]}'), (1, 4, "b", '{"class_name":["z"]}'),
        (1, 5, "c", "not json"), (1, 5, "c", None), (1, 5, "c", "[1]"), (1, 5, "c", "{}"),
        (2, 1, "d", '{"人数":1}'), (2, 1, "d", '{"人数":1}'), (None, 1, "e", '{"人数":1}'), (3, 1, "f", '{"班级名称":true}'), (3, 2, "g", '{"班级名称":1.5}'),
    ])
    assert rows(drift.schema_changes(df, alias)) == sorted([
        ("b", "class_name", "renamed"), ("b", "class_name", "retyped"), ("b", "count", "retyped"), ("b", "location", "added"),
        ("c", "class_name", "removed"), ("c", "count", "removed"), ("c", "座位", "removed"), ("c", "location", "removed"), ("g", "class_name", "retyped"),
    ])
    assert drift.schema_changes(df.limit(0), alias).count() == 0


def test_rescue_and_replay(spark):
    alias = spark.createDataFrame(ALIAS, "field string, alias_pos int, alias string")
    df = _sheet(spark, [
        (1, 1, "a", '{"班级名称":"x","人数":" 5 ","座\\"位\\n":{"n":1,"m":2}}'), (1, 1, "a", '{"人数":"many","地点":["p"],"N ":7}'), (1, 1, "a", "bad"), (1, 1, "a", None),
        (1, 1, "a", "{}"), (1, 1, "a", "[1]"), (1, 1, "a", '{"class name":"second","班级 名称":"first","地点":null,"x":true}'),
        (1, 1, "a", '{"n":"x","n":1.5,"N_":" 8","人数":2.5}'), (1, 1, "a", '{"count":3,"ｎ":9}'),
    ]).withColumn("class_name", F.lit("clash")).withColumns({c: F.lit("own") for c in ("_m", "_h", "_v", "_own", "_row", "_gone", "a.b")})
    for most in (100, 0):  # a literal, and a join
        given = drift.rescue_rows(df, alias, most_aliases=most)
        assert all(tuple(r) == ("own",) * 7 for r in drift.replay(given, {"n": "int"}).select("_m", "_h", "_v", "_own", "_row", "_gone", "`a.b`").collect())
        assert [r["rescued"] for r in given.filter("sheet_row_id in (1, 7)").orderBy("sheet_row_id").collect()] == ['{"人数":"many","地点":["p"],"N ":7}', '{"n":"x","n":1.5,"N_":" 8","人数":2.5}']
        out = drift.replay(given, {"n": "int"}).orderBy("sheet_row_id").collect()
        assert [(r["class_name"], r["count"], r["rescued"], r["n"]) for r in out] == [
            ("x", 5, '{"座\\"位\\n":{"m":2,"n":1}}', None), (None, None, '{"人数":"many","地点":["p"]}', 7), (None, None, '{"_payload":"bad"}', None),
            (None, None, None, None), (None, None, None, None), (None, None, '{"_payload":"[1]"}', None), ("first", None, '{"x":true}', None),
            (None, None, '{"n":"x","n":1.5,"人数":2.5}', 8), (None, None, '{"count":3}', 9),
        ]
        assert [tuple(c) for c in out[6]["origin"]] == [
            ("class name", "classname", "class_name", True, 2, "string"), ("班级 名称", "班级名称", "class_name", True, 1, "string"),
            ("地点", "地点", "location", True, 1, None), ("x", "x", "x", False, 0, None),
        ]
    twice = [(1, '{"地点":"A"}'), (1, '{"地点":"B","人数":3}'), (1, '{"地点":"B","人数":3}'), (None, '{"地点":"C","k":[1]}'), (None, None), (None, "bad")]
    df = spark.createDataFrame([(i, None, None, None, 1, p) for i, p in twice], "sheet_row_id bigint, series_id int, file_seq int, source_file string, row_index int, payload string")
    columns = ["sheet_row_id", "location", "count", "rescued"]
    expected = rows(spark.createDataFrame([(1, "A", None, None), (1, "B", 3, None), (1, "B", 3, None), (None, "C", None, '{"k":[1]}'), (None,) * 4, (None, None, None, '{"_payload":"bad"}')], "a bigint, b string, c int, d string"))
    for most in (100, 0):
        assert rows(drift.rescue_rows(df, alias, most_aliases=most).select(columns)) == expected
    assert drift.rescue_rows(df.limit(0), alias).count() == 0
    assert [r["rescued"] for r in drift.rescue_rows(df, alias.limit(0)).filter("location is null and sheet_row_id is null").collect()].count('{"地点":"C","k":[1]}') == 1


def test_rescue_paths_agree_on_a_whole_table(spark, sf_dir):
    t, alias = table(spark, sf_dir, "exam_sheet_row"), table(spark, sf_dir, "header_alias")
    literal, joined = (drift.rescue_rows(t, alias, most_aliases=most) for most in (100, 0))
    assert rows(literal) == rows(joined) and rows(drift.schema_changes(t, alias)) == rows(drift.schema_changes(t, alias, most_aliases=0))


def test_changes_of_repeated_headers(spark):
    alias = spark.createDataFrame(ALIAS, "field string, alias_pos int, alias string")
    twice = _sheet(spark, [(1, 1, "a", '{"地点":"p","地点":"q"}'), (1, 2, "b", '{"n":1,"n":2}')])
    assert rows(drift.schema_changes(twice, alias)) == [("b", "location", "removed"), ("b", "n", "added")]
