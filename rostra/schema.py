"""The standard record, the header aliases and the fixed word lists."""

from pyspark.sql import types as T

# Header aliases of each standard field in priority order.
ALIASES = {
    "campus": ["校区", "校区名称"],
    "course_name": ["课程名称", "课程", "考试课程"],
    "course_code": ["课程代码", "选课课号"],
    "class_name": ["班级名称", "班级", "班级代码", "行政班级"],
    "teacher": ["任课教师", "教师", "监考教师"],
    "location": ["考试教室", "教室名称", "地点", "考试地点"],
    "raw_time": ["考试时间", "时间"],
    "count": ["人数", "学生人数", "考试人数"],
    "school": ["开课学院", "学院"],
    "student_school": ["学生所在学院", "所在学院"],
    "major": ["专业名称", "专业"],
    "grade": ["年级"],
    "notes": ["备注"],
}

# Word lists of the notice and attachment filters.
EXCLUDE_WORDS = ["阶段性", "补考", "清欠", "分级", "补学", "换证", "重修", "选拔", "竞赛", "发车", "监考"]
REQUIRED_WORDS = ["学年", "学期"]
TARGET_WORDS = ["考试安排表", "期末考试", "课程结束考试"]
STUDENT_WORDS = ["学生"]
TEACHER_WORDS = ["监考", "教师", "巡考", "教务员"]

# Error classes of the time parser.
MISSING_TIME = "Missing time data"
UNRECOGNIZED_TIME = "Unrecognized date format"
IMPOSSIBLE_TIME = "Parsing exception"

# Display limits.
MAX_CLASSES, MAX_ERRORS, MAX_SAMPLES, MIN_TERM = 50, 10, 3, 2
DEFAULT_REMINDERS = [30, 60]

TEXT_FIELDS = [f for f in ALIASES if f != "count"]

# The fields of the standard record, in their order.
RECORD_FIELDS = [
    "id", "campus", "course_name", "course_code", "class_name", "teacher", "location", "raw_time", "count", "school",
    "student_school", "major", "grade", "notes", "start_timestamp", "end_timestamp", "duration_minutes", "date", "parse_error",
]

RECORD_SCHEMA = T.StructType(
    [T.StructField(f, T.IntegerType() if f in ("count", "duration_minutes") else T.StringType()) for f in RECORD_FIELDS]
)
