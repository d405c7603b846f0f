import json

import pytest
from pyspark.sql import functions as F
from samples import block, line, lines_df

from logspark.operators.combine import sort_by_time
from logspark.operators.filters import min_level
from logspark.operators.parse import parse_lines, usable_entries
from logspark.operators.quality import file_report
from logspark.schema import FIELDS
from logspark.sinks import text as sinks
from logspark.sources.lines import read_lines, stream_lines
from logspark.streaming import logs as streaming

E = "\x1b"
TEXTS = [
    line(3, "rep:run", 1, data={"session": "14.2", "container-guid": "278d<8c&4b"}),
    line(1, "a-very-long-source-name", 2, session="s", error="first\nsecond", trace="at x"),
    line(2, "bbs", 0, data={}),
    '{"timestamp":"2018-05-10T13:01:02.000000003Z","source":"tps","message":"q\\"\\u0001","level":"fatal"}',
]


@pytest.fixture(scope="module")
def entries(spark):
    return usable_entries(lines_df(spark, TEXTS)).cache()


def test_json_lines(entries):
    rows = [r[0] for r in sort_by_time(entries).select(sinks.json_line()).collect()]
    assert rows[1] == (
        '{"timestamp":"2018-03-13T23:30:02.000000002Z","log_level":"debug","source":"bbs",'
        '"message":"bbs.step-2"}'
    )
    assert rows[2] == (
        '{"timestamp":"2018-03-13T23:30:02.000000003Z","log_level":"info","source":"rep:run",'
        '"message":"rep:run.step-3","session":"14.2",'
        '"data":{"container-guid":"278d\\u003c8c\\u00264b"}}'
    )
    assert list(json.loads(rows[0])) == [
        "timestamp", "log_level", "source", "message", "session", "error", "trace",
    ]
    plain = [r[0] for r in entries.select(sinks.json_line(escape_html=False)).collect()]
    assert any("278d<8c&4b" in r for r in plain)
    assert sorted(map(str, map(json.loads, plain))) == sorted(map(str, map(json.loads, rows)))


def test_json_round_trip(spark, entries, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_json_lines(sort_by_time(entries), out)
    again = usable_entries(read_lines(spark, out))
    assert sorted(map(tuple, again.select(*FIELDS).collect()), key=str) == sorted(
        map(tuple, entries.select(*FIELDS).collect()), key=str
    )
    with pytest.raises(Exception):
        sinks.write_json_lines(entries, out)
    sinks.write_json_lines(again.limit(0), out + "2", compression="gzip")


def test_written_order(spark, tmp_path):
    out = str(tmp_path / "sorted")
    many = usable_entries(lines_df(spark, [line(i * 37 % 500) for i in range(500)])).repartition(6)
    sinks.write_json_lines(sort_by_time(many), out)
    parts = sorted((tmp_path / "sorted").glob("part-*"))
    written = [json.loads(t)["message"] for p in parts for t in p.read_text().splitlines()]
    assert written == [f"rep.step-{i}" for i in range(500)]


def test_pretty_plain(entries):
    rows = [r[0] for r in sort_by_time(entries).select(sinks.pretty_text(color=False)).collect()]
    margin = " " * 27
    assert rows[0] == (
        "a-very-long-source-name [ERROR] 03/13 23:30:02.00 s          a-very-long-source-name.step-1\n"
        f"{margin}first\n{margin}second\n{margin}at x\n"
    )
    assert rows[1] == f"bbs              [DEBUG] 03/13 23:30:02.00 {' ' * 10} bbs.step-2\n"
    assert rows[2] == (
        "rep:run          [INFO]  03/13 23:30:02.00 14.2       rep:run.step-3\n"
        f'{margin}{{"container-guid":"278d\\u003c8c\\u00264b"}}\n'
    )
    assert rows[3].startswith("tps              [FATAL] 05/10 13:01:02.00            q")


def test_pretty_color(entries):
    rows = [r[0] for r in sort_by_time(entries).select(sinks.pretty_text()).collect()]
    assert rows[0].endswith(f"{E}[91m{' ' * 27}at x\n{E}[0m")
    assert rows[2].startswith(
        f"{E}[93mrep:run         {E}[0m {E}[93m[INFO] {E}[0m {E}[93m03/13 23:30:02.00{E}[0m "
        f"{E}[90m14.2      {E}[0m {E}[93mrep:run.step-3{E}[0m\n"
    )
    assert f"{E}[90m[DEBUG]{E}[0m" in rows[1] and f"{E}[91m[FATAL]{E}[0m" in rows[3]


def test_write_pretty_and_stripped(spark, entries, tmp_path):
    sinks.write_pretty(sort_by_time(entries), str(tmp_path / "p"), color=False)
    written = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    texts = [r[0] for r in sort_by_time(entries).select(sinks.pretty_text(color=False)).collect()]
    assert written == "".join(texts)
    sinks.write_pretty(sort_by_time(entries), str(tmp_path / "c"))
    colored = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert f"at x{E}[0m\n" in colored
    sinks.write_stripped(lines_df(spark, [f"{E}[1ma{E}[0m", "b"]), str(tmp_path / "s"))
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "s")).collect()) == ["a", "b"]


def test_write_report(spark, tmp_path):
    lines = lines_df(spark, [line(), "x"]).withColumn("file", F.lit("a.log"))
    report = file_report(parse_lines(lines))
    sinks.write_report(report, str(tmp_path / "p"))
    sinks.write_report(report, str(tmp_path / "c"), format="csv")
    assert tuple(spark.read.parquet(str(tmp_path / "p")).first()) == ("a.log", 2, 1, 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().total_lines == "2"
    with pytest.raises(ValueError):
        sinks.write_report(report, str(tmp_path / "x"), format="xml")


def run(stream, tmp_path, name):
    """Process what is there and give all output so far."""
    out = str(tmp_path / name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / f"state-{name}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(block(5, "a") + b"junk\n\n")
    lines = stream_lines(spark, str(tmp_path / "in"), glob="*.log")
    found = streaming.stream_entries(lines, where=min_level("info"))
    assert run(found.select(*FIELDS), tmp_path, "s1").count() == 5
    (tmp_path / "in" / "b.log").write_bytes(block(3, "b"))
    (tmp_path / "in" / "c.txt").write_bytes(block(3, "c"))
    got = run(found.select(*FIELDS), tmp_path, "s1")
    assert sorted(r.source for r in got.collect()) == ["a"] * 5 + ["b"] * 3


def test_stream_cannot_sort(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = stream_lines(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError):
        streaming.stream_entries(lines, sort=True)
    with pytest.raises(ValueError):
        sort_by_time(streaming.stream_entries(lines))
    with pytest.raises(ValueError):
        streaming.stream_entries(lines_df(spark, []))


def test_stream_unique(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(block(5) + block(5))
    (tmp_path / "in" / "b.log").write_bytes(block(7))
    lines = stream_lines(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    unique = streaming.stream_unique(streaming.stream_entries(lines), "1 hour")
    assert run(unique.select(*FIELDS), tmp_path, "s2").count() == 7


def test_stream_batches_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(block(5, start=5) + block(5))
    seen = []
    found = streaming.stream_entries(stream_lines(spark, str(tmp_path / "in")))
    query = (
        streaming.write_stream_sorted(found, lambda df, _: seen.extend(r.nanos for r in df.collect()))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert seen == list(range(10))
