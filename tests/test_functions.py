import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logspark.functions import levels, patterns, text, timestamps
from logspark.functions.entry import _indent_json

MAX = str(2**64 - 1)

# text, seconds, nanoseconds (None: not an epoch)
EPOCHS = [
    ("123", 123, 0),
    ("1.123456789", 1, 123456789),
    ("1.012345678", 1, 12345678),
    ("1.5", 1, 500_000_000),
    ("1.05", 1, 50_000_000),
    ("1.050", 1, 50_000_000),
    ("1.00", 1, 0),
    ("0", None, None),
    (".0", None, None),
    ("1.", None, None),
    ("1.00.", None, None),
    ("1.1234567899", None, None),
    (MAX, None, None),
    (f"1.{MAX}", None, None),
    (f"{MAX}.{MAX}", None, None),
    ("5", None, None),
    ("12", 12, 0),
    ("1520983802", 1520983802, 0),
    ("1520983802123", None, None),
    (f"{MAX}.5", None, None),
    ("12\n", None, None),
    ("01.5", None, None),
    ("-1.5", None, None),
    ("", None, None),
]


def test_epoch_texts(spark):
    df = spark.createDataFrame(EPOCHS, "t string, sec long, ns long")
    sec = timestamps.epoch_seconds(F.col("t"))
    ns = timestamps.epoch_nanos(F.col("t"), sec)
    for row in df.select("*", sec.alias("got_sec"), ns.alias("got_ns")).collect():
        assert (row.got_sec, row.got_ns) == (row.sec, row.ns), row.t


RFC3339 = [
    ("2018-05-10T13:01:02Z", 1525957262, 0),
    ("2018-05-10T13:01:02.000000003Z", 1525957262, 3),
    ("2018-05-10T13:01:02.1234567891Z", 1525957262, 123456789),
    ("2018-05-10T15:01:02.5+02:00", 1525957262, 500_000_000),
    ("2018-05-10T07:31:02-05:30", 1525957262, 0),
    ("1969-12-31T23:59:59.25Z", -1, 250_000_000),
    ("2016-02-29T00:00:00Z", 1456704000, 0),
    ("2018-02-29T00:00:00Z", None, None),
    ("2018-05-10T25:00:00Z", None, None),
    ("2018-05-10 13:01:02Z", None, None),
    ("2018-05-10T13:01:02", None, None),
    ("2018-05-10", None, None),
    ("2018-05-10T13:01:02z", None, None),
]


def test_rfc3339_texts(spark):
    df = spark.createDataFrame(RFC3339, "t string, sec long, ns long")
    instant = timestamps.rfc3339_instant(F.col("t"))
    got = df.select(
        "*",
        F.unix_seconds(instant).alias("got_sec"),
        timestamps.rfc3339_nanos(F.col("t"), instant).alias("got_ns"),
    )
    for row in got.collect():
        ns = row.ns or None if "." not in row.t else row.ns
        assert row.got_sec == row.sec, row.t
        assert (row.got_ns or 0) == (ns or 0), row.t


def test_time_texts(spark):
    df = spark.createDataFrame(
        [(1525957262, 3), (1525957262, 0), (1525957262, 120_000_000), (-1, 999_999_999), (2**60, 5)],
        "s long, n int",
    )
    rows = df.select(
        timestamps.display_time(F.col("s"), F.col("n")).alias("d"),
        timestamps.rfc3339_text(F.col("s"), F.col("n")).alias("r"),
        timestamps.rfc3339_text(F.col("s"), F.col("n"), "America/New_York").alias("z"),
        timestamps.display_time(F.col("s"), F.col("n"), "America/New_York").alias("l"),
        timestamps.to_timestamp(F.col("s"), F.col("n")).isNull().alias("beyond"),
    ).collect()
    assert [r.d for r in rows[:4]] == [
        "05/10 13:01:02.00",
        "05/10 13:01:02.00",
        "05/10 13:01:02.12",
        "12/31 23:59:59.99",
    ]
    assert [r.r for r in rows[:4]] == [
        "2018-05-10T13:01:02.000000003Z",
        "2018-05-10T13:01:02Z",
        "2018-05-10T13:01:02.12Z",
        "1969-12-31T23:59:59.999999999Z",
    ]
    assert rows[1].z == "2018-05-10T09:01:02-04:00"
    assert rows[2].l == "05/10 09:01:02.12"
    assert rows[4].r is None and rows[4].beyond


def test_time_bounds():
    utc = dt.timezone.utc
    bound = timestamps.bound_instant
    assert bound(dt.datetime(2018, 5, 10, 13, 1, 2, 3)) == (1525957262, 3000)
    assert bound(dt.datetime(2018, 5, 10, 13, 1, 2, tzinfo=utc)) == (1525957262, 0)
    assert bound(1525957262) == (1525957262, 0)
    assert bound("1525957262.000000003") == (1525957262, 3)
    assert bound(Decimal("-0.5")) == (-1, 500_000_000)
    assert bound("2018-05-10T13:01:02.000000003Z") == (1525957262, 3)
    now = dt.datetime(2018, 6, 1, tzinfo=utc)
    assert bound("05/10 13:01:02.12", now) == (1525957262, 120_000_000)
    assert bound(dt.timedelta(minutes=-1), now) == (1527811140, 0)
    for wrong in ("yesterday", "2018-05-10", True):
        with pytest.raises(ValueError):
            bound(wrong)


def test_levels(spark):
    texts = ["0", "3", "4", "debug", "fatal", "INFO", "", "null", "1.0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(levels.decode_level(F.col("t"))).collect()]
    assert got == [0, 3, None, 0, 3, None, None, None, None, None]
    numbers = spark.createDataFrame([(0,), (3,), (4,), (-1,), (None,)], "n int")
    names = numbers.select(levels.level_name(F.col("n")), levels.level_label(F.col("n"))).collect()
    assert [tuple(r) for r in names] == [
        ("debug", "DEBUG"),
        ("fatal", "FATAL"),
        ("invalid", "INVALID"),
        ("invalid", "INVALID"),
        (None, None),
    ]
    with pytest.raises(ValueError):
        levels.level_number("warn")
    with pytest.raises(ValueError):
        levels.level_number(4)


E = "\x1b"


def test_strip_escape_sequences(spark):
    colored = (
        f'{{"source":"{E}[01;31m{E}[Krep{E}[m{E}[K","message":"{E}[01;31m{E}[Krep{E}[m{E}[K'
        f'.container-metrics-{E}[01;31m{E}[Krep{E}[m{E}[Korter.tick"}}'
    )
    plain = '{"source":"rep","message":"rep.container-metrics-reporter.tick"}'
    df = spark.createDataFrame([(colored,), (plain,), (f"a{E}",), (f"a{E}[3",), ("",)], "t string")
    once = df.select("t", text.strip_color(F.col("t")).alias("s"))
    rows = once.select("s", text.strip_color(F.col("s")).alias("again")).collect()
    assert [r.s for r in rows] == [plain, plain, f"a{E}", f"a{E}[3", ""]
    assert all(r.s == r.again for r in rows)
    other = spark.createDataFrame([(f"{E}Dxy {E}[1mz",)], "t string")
    got = other.select(text.strip_ansi(F.col("t")), text.strip_color(F.col("t"))).first()
    assert tuple(got) == ("y z", f"{E}Dxy z")


def test_padding_and_indent(spark):
    df = spark.createDataFrame([("ab",), ("äöü",), ("abcdefgh",), ("",)], "t string")
    got = [r[0] for r in df.select(text.pad_right(F.col("t"), 5)).collect()]
    assert got == ["ab   ", "äöü  ", "abcdefgh", "     "]
    df = spark.createDataFrame([("a",), ("a\nb",), ("a\n",)], "t string")
    got = [r[0] for r in df.select(text.indent_block(F.col("t"), 2)).collect()]
    assert got == ["  a\n", "  a\n  b\n", "  a\n  \n"]


def test_components(spark):
    df = spark.createDataFrame([("rep:x:y",), ("tps",), ("nobody",), (":",)], "t string")
    got = df.select(text.component(F.col("t")), text.component_color(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("rep", f"{E}[93m"),
        ("tps", f"{E}[97m"),
        ("nobody", f"{E}[0m"),
        ("", f"{E}[0m"),
    ]


def test_log_types(spark):
    lines = [
        "2018/05/10 13:01:02 started",
        "2018/05/10 13:01:02 [error] 12#0: *1 open() failed",
        "host-1.example - [10/May/2018:13:01:02 +0000] GET / 200",
        "panic: runtime error",
        "",
    ]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    got = [r[0] for r in df.select(text.log_type(F.col("t"))).collect()]
    assert got == ["go_std", "nginx_error", "nginx_access", "unknown", "unknown"]


def test_patterns(spark):
    cases = [
        ("user-7", "x user-7 y", True),
        ("a/b", "a-b", False),
        ("a.c", "xabcx", True),
        ("^b", "ab", False),
        ("c$", "abc\n", False),
        ("c$", "abc", True),
        ("(?m)c$", "abc\nd", True),
        ("[[:digit:]]+x", "a12x", True),
        ("[^[:space:]]z", " z", False),
        ("(?P<n>ab)c", "abc", True),
        ("[a[]", "[", True),
        ("[&&]", "&", True),
        (r"a\.c", "abc", False),
        (r"\$5", "costs $5", True),
        ("[$]", "$", True),
        ("[]a]", "]", True),
        ("a.b", "a\rb", True),
        ("a.b", "a\nb", False),
    ]
    for pattern, value, expected in cases:
        df = spark.createDataFrame([(value,)], "t string")
        assert df.select(patterns.matches(F.col("t"), pattern)).first()[0] is expected, pattern
    for refused in ("(?U)a+", "(?=a)", "(?<!a)b", "(?>a)", "x*+", "x{2}+", r"(a)\1", r"(?P<n>a)\k<n>"):
        with pytest.raises(ValueError):
            patterns.java_regex(refused)
    assert patterns.java_regex(r"[*+]+\*+(?:a)??") == r"(?d)[*+]+\*+(?:a)??"
    with pytest.raises(ValueError):
        patterns.java_regex("[[:nothing:]]")
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(patterns.matches_any(F.col("t"), [])).first()[0] is False


def test_globs(spark):
    cases = [
        ("*.log", "a.log", True),
        ("*.log", "a.log.1", False),
        ("*.log.*.gz", "x.log.1.gz", True),
        ("*.log.*.gz", "x.log.gz", False),
        ("a?c", "abc", True),
        ("a[b-d]c", "acc", True),
        ("a[^b]c", "abc", False),
        (r"a\*c", "a*c", True),
        (r"a\*c", "abc", False),
        ("*", "a/b", False),
        ("a+c", "aac", False),
    ]
    for glob, name, expected in cases:
        df = spark.createDataFrame([(name,)], "t string")
        got = df.select(patterns.glob_matches_any(F.col("t"), [glob])).first()[0]
        assert got is expected and patterns.glob_matches(name, glob) is expected, glob
    for wrong in ("a[", "[]", "a[b-", "\\"):
        with pytest.raises(ValueError):
            patterns.glob_regex(wrong)


def test_contains_ignore_case(spark):
    df = spark.createDataFrame([("RepOrter",), ("rep",)], "t string")
    got = [r[0] for r in df.select(text.contains_ignore_case(F.col("t"), "REPorter")).collect()]
    assert got == [True, False]


def test_indented_json():
    compact = '{"a":[1,{"b":"x, {y}\\"z"},[]],"c":{}}'
    laid_out = _indent_json(compact, "", "  ")
    assert laid_out == (
        '{\n  "a": [\n    1,\n    {\n      "b": "x, {y}\\"z"\n    },\n    []\n  ],\n  "c": {}\n}'
    )
