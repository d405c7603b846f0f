import json
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import line, lines_df

from logspark.functions.text import strip_color
from logspark.operators.parse import parse_lines, usable_entries

T = '"timestamp":"1520983802.429046154"'


def parse_one(spark, text, **options):
    return parse_lines(lines_df(spark, [text]), **options).first()


REJECTED = {
    "not an object": "123",
    "text": "2018/05/10 13:01:02 started",
    "empty": "",
    "trailing text": line() + " trailing",
    "second object": line() + "{}",
    "closing brace": line() + "}",
    "comma": line() + ",",
    "comma and object": line() + ",{}",
    "bracket": line() + "]",
    "bracket brace": line() + "] }",
    "brace missing": line()[:-1],
    "single quotes": "{'source':'a'}",
    "NaN": '{"data":{"a":NaN}}',
    "leading zero": '{"data":{"a":01}}',
    "bare fraction": '{"data":{"a":.5}}',
    "raw control character": '{"source":"a\x1b[0m"}',
    "bad escape": '{"source":"\\x"}',
    "number as source": line(source=None).replace("null", "7", 1),
    "object as message": "{%s,\"message\":{}}" % T,
    "number as session": "{%s,\"session\":1}" % T,
    "array as data": "{%s,\"data\":[1]}" % T,
    "text as data": "{%s,\"data\":\"x\"}" % T,
    "millisecond epoch": '{"timestamp":"1520983802123"}',
    "one digit epoch": '{"timestamp":"5"}',
    "bare one digit with dot": '{"timestamp":5}',
    "bare exponent": '{"timestamp":1e9}',
    "empty time": '{"timestamp":""}',
    "boolean time": '{"timestamp":true}',
    "object time": '{"timestamp":{"a":1.5}}',
    "overflowing seconds": '{"timestamp":"99999999999999999999.5"}',
    "level 4": "{%s,\"log_level\":4}" % T,
    "level upper case": "{%s,\"level\":\"INFO\"}" % T,
    "level 1.0": "{%s,\"level\":1.0}" % T,
    "level boolean": "{%s,\"level\":true}" % T,
    "level empty": "{%s,\"level\":\"\"}" % T,
}


def test_rejected_lines(spark):
    rows = parse_lines(lines_df(spark, list(REJECTED.values()))).collect()
    for (why, text), row in zip(REJECTED.items(), rows):
        assert row.kind == "raw" and row.raw == text, why
        assert row.epoch_sec is None and row.source is None and row.log_level is None, why


def test_version_one(spark):
    row = parse_one(
        spark,
        '{"timestamp":"1520983802.429046154","source":"rep","message":"rep.tick","log_level":1,'
        '"data":{"session":"9.5724.1.1","driver-paths":["/a", "/b"],"b":{"z":1,"a":2}}}',
    )
    assert row.kind == "lager" and row.raw is None
    assert (row.epoch_sec, row.nanos) == (1520983802, 429046154)
    assert (row.log_level, row.level_name) == (1, "info")
    assert (row.source, row.message, row.session) == ("rep", "rep.tick", "9.5724.1.1")
    assert row.error is None and row.trace is None
    assert row.data == '{"b":{"a":2,"z":1},"driver-paths":["/a","/b"]}'


def test_version_two(spark):
    row = parse_one(
        spark,
        ' \t{"timestamp":"2018-05-10T13:01:02.000000003Z","source":"rep","message":"m","level":"error"}\r',
    )
    assert (row.kind, row.epoch_sec, row.nanos) == ("lager", 1525957262, 3)
    assert (row.log_level, row.level_name, row.data) == (2, "error", None)


ACCEPTED = [
    # line, column, value
    ('{"timestamp":1520983802.429046154}', "nanos", 429046154),
    ('{"timestamp":1520983802}', "epoch_sec", 1520983802),
    ('{"timestamp":12.0}', "epoch_sec", 12),
    ("{%s}" % T, "source", ""),
    ("{%s}" % T, "log_level", 0),
    ('{%s,"source":null,"data":null,"level":null}' % T, "kind", "lager"),
    ('{%s,"log_level":"2"}' % T, "log_level", 2),
    ('{%s,"log_level":1,"level":"fatal"}' % T, "log_level", 3),
    ('{%s,"log_level":3,"level":"info"}' % T, "log_level", 3),
    ('{%s,"source":"a","source":"b"}' % T, "source", "b"),
    ('{%s,"data":{"a":1,"a":2}}' % T, "data", '{"a":2}'),
    ('{%s,"unknown":{"x":[1]}}' % T, "kind", "lager"),
    ('{%s,"session":"top","data":{"session":"inner"}}' % T, "session", "top"),
    ('{%s,"session":"","data":{"session":"inner"}}' % T, "session", "inner"),
    ('{%s,"data":{"session":""}}' % T, "session", None),
    ('{%s,"data":{"session":5,"a":1}}' % T, "session", None),
    ('{%s,"data":{"session":5,"a":1}}' % T, "data", '{"a":1}'),
    ('{%s,"data":{"error":{"code":1}}}' % T, "data", None),
    ('{%s,"session":"top","data":{"session":"inner"}}' % T, "data", None),
    ('{%s,"data":{"trace":"t\\n\\u00e9"}}' % T, "trace", "t\né"),
    ('{%s,"data":{}}' % T, "data", None),
    ('{%s,"SOURCE":"x"}' % T, "source", ""),
    ('{%s,"data":{"n":12345678901234567890.123456789}}' % T, "data",
     '{"n":12345678901234567890.123456789}'),
    ("{}", "kind", "no_timestamp"),
    ('{"timestamp":null,"source":"a"}', "kind", "no_timestamp"),
    ('{"timestamp":null,"source":"a"}', "source", "a"),
    ('{"timestamp":"0001-01-01T00:00:00Z"}', "kind", "no_timestamp"),
]


def test_accepted_lines(spark):
    rows = parse_lines(lines_df(spark, [c[0] for c in ACCEPTED])).collect()
    for (text, column, value), row in zip(ACCEPTED, rows):
        assert row.kind != "raw", text
        assert row[column] == value, (text, column)


def test_options(spark):
    upper = '{"Timestamp":"12.5","SOURCE":"x","source":"y","LEVEL":"info","data":{"Session":"s"}}'
    row = parse_one(spark, upper, case_insensitive_keys=True)
    assert (row.epoch_sec, row.source, row.log_level) == (12, "y", 1)
    assert row.session is None and row.data == '{"Session":"s"}'
    kept = parse_one(
        spark, '{%s,"data":{"error":{"code":1},"session":"s"}}' % T, keep_nonstring=True
    )
    assert (kept.data, kept.error, kept.session) == ('{"error":{"code":1}}', None, "s")


def test_colored_and_plain_lines(spark):
    e = "\x1b"
    colored = [line(i, f"{e}[01;31m{e}[Krep{e}[m{e}[K").replace("\\u001b", e) for i in range(10)]
    plain = [line(i) for i in range(10)]
    lines = lines_df(spark, [t for pair in zip(colored, plain) for t in pair])
    assert usable_entries(lines).count() == 10
    stripped = usable_entries(lines.select(strip_color(F.col("value")).alias("value")))
    assert stripped.count() == 20 and stripped.distinct().count() == 10


def test_every_line_gets_one_kind(spark):
    texts = list(REJECTED.values()) + [c[0] for c in ACCEPTED]
    kinds = parse_lines(lines_df(spark, texts)).groupBy("kind").count().collect()
    assert sum(r["count"] for r in kinds) == len(texts)
    assert {r.kind for r in kinds} == {"lager", "no_timestamp", "raw"}


def test_filter_does_not_parse_twice(spark):
    plan = usable_entries(lines_df(spark, [line()]))._jdf.queryExecution().optimizedPlan()
    # Once for every line, once for those with a field of unsure type, once for values cut out.
    assert plan.toString().count("from_json") == 3


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=5), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.text(max_size=6), json_values, max_size=4), min_size=10, max_size=30))
def test_data_survives(spark, many):
    clean = [
        {k: v for k, v in d.items() if k not in ("session", "error", "trace")} for d in many
    ]
    texts = [json.dumps({"timestamp": f"{i + 10}.5", "data": d}) for i, d in enumerate(clean)]
    texts = [t for t in texts if "\\ud" not in t]  # lone surrogates print differently
    rows = usable_entries(lines_df(spark, texts)).orderBy("epoch_sec").collect()
    assert len(rows) == len(texts)
    for text, row in zip(texts, rows):
        assert json.loads(row.data or "{}") == json.loads(text)["data"]


@pytest.mark.parametrize("size", [100_000])
def test_long_line(spark, size):
    text = line(message="x" * size)
    assert len(parse_one(spark, text).message) == size


def test_long_valid_lines_are_entries(spark):
    stamp = '"timestamp":"1700000000.000000001"'
    deep = "[" * 1200 + "1" + "]" * 1200
    values = [
        f'{{{stamp},"message":"{"x" * 21_000_000}"}}',
        f'{{{stamp},"message":"{{{"x" * 21_000_000}"}}',
        f'{{{stamp},"data":{{"a":{deep}}}}}',
        f'{{{stamp},"message":"1","data":{{"a":{deep}}}}}',
        f'{{{stamp},"data":{{"a":{"7" * 1200}}}}}',
    ]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert [r.kind for r in parse_lines(df).select("kind").collect()] == ["lager"] * 5


def test_infinite_numbers_are_no_text(spark):
    values = [f'{{"timestamp":"1700000000","{k}":{v}1e400}}' for k in ("source", "message") for v in ("", "-")]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert {r.kind for r in parse_lines(df).collect()} == {"raw"}
    df = spark.createDataFrame([('{"timestamp":"1700000000","source":"Infinity"}',)], "value string")
    assert [(r.kind, r.source) for r in parse_lines(df).collect()] == [("lager", "Infinity")]


def nested(depth, kind="array", data='{"n":%s}'):
    opens, closes = ("[", "]") if kind == "array" else ('{"a":', "}")
    inner = opens * depth + ("" if kind == "array" else "1") + closes * depth
    return '{"timestamp":"1700000000.5","source":"s","data":' + data % inner + "}"


@pytest.mark.parametrize("options", [{}, {"case_insensitive_keys": True}])
@pytest.mark.parametrize("kind", ["array", "object"])
def test_deep_nesting_does_not_end_the_session(spark, kind, options):
    depths = (1, 100, 498, 499, 1200, 5000, 9998, 9999, 11000)
    lines = [(d, nested(d, kind)) for d in depths]
    parsed = parse_lines(spark.createDataFrame(lines, "depth int, value string"), **options).collect()
    assert len(parsed) == len(depths)
    for row in parsed:
        text = nested(row.depth, kind)
        if row.depth <= 9998:
            assert (row.kind, row.raw) == ("lager", None), row.depth
            assert row.data == text[text.index('{"n"') : -1]
        else:
            assert (row.kind, row.raw, row.data) == ("too_deep", text, None), row.depth


def test_deep_values_come_back_in_their_places(spark):
    deep, other = "[" * 700 + "]" * 700, '{"k": ' * 600 + '"[\\"]" ' + "}" * 600
    data = f'{{"b": [1, {deep}], "session": {deep}, "a": {other}, "c": [[2]], "error": "e"}}'
    text = f'{{"timestamp":"1700000000.5","source":"s","x":{deep},"data":{data}}}'
    row = parse_one(spark, text)
    assert (row.kind, row.session, row.error) == ("lager", None, "e")
    assert row.data == f'{{"a":{other.replace(" ", "")},"b":[1,{deep}],"c":[[2]]}}'
    again = '{"timestamp":"1700000000.5","data":' + row.data + "}"
    assert parse_one(spark, again).data == row.data


@pytest.mark.parametrize("value", ['"message":%s', '"data":%s', '"data":{"a":%s,}', '"data":{"a":%s]}', '"session":%s', '"data":{"a":[%s"x" 1]}'])
def test_deep_values_of_wrong_type_or_broken(spark, value):
    text = '{"timestamp":"1700000000.5","source":"s",' + value % ("[" * 700 + "]" * 700) + "}"
    assert parse_one(spark, text).kind == "raw"


@pytest.mark.parametrize("inside", ["1 2", '"a":1', "tru", '"\\x"', "[}", "01"])
def test_broken_deep_pieces(spark, inside):
    text = '{"timestamp":"1700000000.5","data":{"a":' + "[" * 700 + inside + "]" * 700 + "}}"
    assert parse_one(spark, text).kind == "raw"


def test_depth_counts_only_what_is_open(spark):
    many = '{"n":[' + ",".join(["[]", "{}"] * 3000) + "]}"
    quoted = '{"n":"' + "[{" * 3000 + '\\\\\\"' + "[" * 3000 + '"}'
    cases = [
        (1, '{"timestamp":"1700000000.5","source":"s","data":' + many + "}", "lager"),
        (2, '{"timestamp":"1700000000.5","source":"s","data":' + quoted + "}", "lager"),
        (3, '{"timestamp":"1700000000.5","message":"' + "[" * 5000 + '}', "raw"),
        (4, '{"timestamp":"1700000000.5","data":{"n":' + "[" * 5000 + "}", "raw"),
        (5, nested(5000) + " trailing", "raw"),
        (6, "[" * 5000 + "]" * 5000, "raw"),
        (7, '{"timestamp":"1700000000.5","source":"\\"","data":{"a":"\\\\","b":' + "[" * 600 + "]" * 600 + "}}", "lager"),
        (8, '{"timestamp":"1700000000.5","data":{"n":' + "[" * 12000 + "]" * 12000 + "}}", "too_deep"),
    ]
    table = spark.createDataFrame([(i, v) for i, v, _ in cases], "i int, value string")
    got = {r.i: r.kind for r in parse_lines(table).collect()}
    assert got == {i: kind for i, _, kind in cases}


def test_deep_lines_count_as_failed(spark):
    from logspark.operators.quality import file_report

    table = spark.createDataFrame([("f", nested(11000)), ("f", nested(2))], "file string, value string")
    row = file_report(parse_lines(table)).first()
    assert (row.total_lines, row.error_lines, row.valid_lines) == (2, 1, 1)


def seconds_to_parse(table):
    began = time.perf_counter()
    parse_lines(table).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize(("kind", "depth"), [("array", 9000), ("object", 9000), ("array", 1200)])
def test_deep_lines_cost_what_their_text_costs(spark, kind, depth):
    """Not a step for each bracket: about as much as brackets in a string of the same length."""
    text = nested(depth, kind)
    flat = '{"timestamp":"1700000000.5","source":"s","data":{"n":"' + "[{" * (len(text) // 2) + '"}}'
    blanks = F.repeat(F.lit(" "), (F.col("id") % 3).cast("int"))
    both = [spark.range(0, 480 * 9000 // depth, numPartitions=4).select(F.concat(F.lit(t), blanks).alias("value")) for t in (text, flat)]
    deep, quoted = (min(seconds_to_parse(table) for _ in range(3)) for table in both)
    assert deep < 6 * quoted, (deep, quoted)
