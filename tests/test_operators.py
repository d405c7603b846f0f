import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from samples import line, lines_df

from logspark.operators import combine, filters, quality
from logspark.operators.parse import parse_lines, usable_entries
from logspark.plans.sample_lines import events
from logspark.schema import FIELDS
from logspark.session import cut_lineage, scratch_path, shared_folder, spread


@pytest.fixture(scope="module")
def entries(spark):
    texts = [
        line(1, "bbs", 0),
        line(2, "rep:x", 1),
        line(3, "rep:y", 2, data={"session": "9.3", "error": "boom", "n": 1}),
        line(4, "tps", 3, data={"trace": "at main", "k": 'a "quoted" <b>'}),
    ]
    return usable_entries(lines_df(spark, texts)).cache()


def found(entries, condition):
    return sorted(r.nanos for r in entries.where(condition).collect())


def at(nanos):
    return f"1520983802.{nanos:09d}"


def test_time_range(entries):
    assert found(entries, filters.time_range(at(2), at(3))) == [2, 3]
    assert found(entries, filters.time_range(at(1), at(3), closed="neither")) == [2]
    assert found(entries, filters.time_range(start=at(3))) == [3, 4]
    assert found(entries, filters.time_range(end=at(1))) == [1]
    assert found(entries, filters.time_range(at(2), at(2))) == [2]
    assert found(entries, filters.time_range()) == [1, 2, 3, 4]
    assert found(entries, filters.time_range(end=Decimal("1520983802.000000003"))) == [1, 2, 3]
    assert found(entries, filters.time_range(start=dt.timedelta(days=-1))) == []
    assert found(entries, filters.time_range("2018-03-13T23:30:02.000000002Z")) == [2, 3, 4]
    with pytest.raises(ValueError):
        filters.time_range(at(3), at(2))
    with pytest.raises(ValueError):
        filters.time_range(at(3), closed="left")


def test_levels(entries):
    assert found(entries, filters.min_level("error")) == [3, 4]
    assert found(entries, filters.min_level(0)) == [1, 2, 3, 4]
    assert found(entries, filters.level_in(["debug", 3])) == [1, 4]
    for call in (lambda: filters.level_in([]), lambda: filters.min_level(7)):
        with pytest.raises(ValueError):
            call()


def test_line_tests(spark):
    texts = ['{"level": "info"}', '{"log_level":2}', '{"level" : "info"}', '{"level":"debug"}', "x"]
    df = lines_df(spark, texts)
    assert df.where(filters.line_min_level(1)).count() == 2
    assert df.where(filters.line_filter({"source": ["debug", "^x$"]})).count() == 2
    assert df.where(filters.line_filter()).count() == 5


def test_field_patterns(entries):
    assert found(entries, filters.field_matches("source", "rep")) == [2, 3]
    assert found(entries, filters.field_matches("source", ["^bbs$", "tps"])) == [1, 4]
    assert found(entries, filters.field_matches("error", "o+m")) == [3]
    assert found(entries, filters.field_matches("error", "^$")) == []
    assert found(entries, filters.field_matches("data", "<b>")) == [4]
    with pytest.raises(ValueError):
        filters.field_matches("file", "x")


def test_composite(entries):
    composite = filters.entry_filter
    assert found(entries, composite()) == [1, 2, 3, 4]
    assert found(entries, composite(level=1)) == [2, 3, 4]
    assert found(entries, composite(start=at(2), end=at(3), level="error")) == [3]
    assert found(entries, composite(fields={"source": "bbs", "trace": "main"})) == [1, 4]
    assert found(entries, composite(level=1, fields={"source": "bbs", "trace": "main"})) == [4]


def file_lines(spark, files):
    rows = [(f, t) for f, texts in files.items() for t in texts]
    return spark.createDataFrame(rows, "file string, value string")


@pytest.fixture(scope="module")
def mixed(spark):
    good = [line(i) for i in range(3)]
    return file_lines(
        spark,
        {
            "ok": good,
            "99": good + ["junk"] * 99,
            "100": good + ["junk"] * 100,
            "no_time": good + ["{}"] * 100,
            "bad": ["junk"],
            "one": ["junk"] * 98 + ["{}"] + [line(9)],
        },
    )


@pytest.mark.parametrize("broadcast_bytes", [0, quality.BROADCAST_BYTES])
def test_file_gate(mixed, broadcast_bytes):
    kept = quality.file_gate(parse_lines(mixed), broadcast_bytes=broadcast_bytes)
    counts = {r.file: r["count"] for r in kept.groupBy("file").count().collect()}
    assert counts == {"ok": 3, "99": 3, "one": 1}


def test_file_gate_limit_and_nothing_dropped(mixed):
    kept = quality.file_gate(parse_lines(mixed), bad_line_limit=1)
    assert {r.file for r in kept.select("file").distinct().collect()} == {"ok"}
    kept = quality.file_gate(parse_lines(mixed), bad_line_limit=1000)
    assert kept.count() == 13


@pytest.mark.parametrize("broadcast_bytes", [0, quality.BROADCAST_BYTES])
def test_gate_by_member_and_faults(spark, broadcast_bytes):
    rows = [
        ("a.tar", "x", line(1), None),
        ("a.tar", "y", line(2), None),
        ("a.tar", "y", None, "EOFError"),
        ("b.tar", "x", line(3), None),
        ("b.tar", None, None, "ReadError"),
        ("c.log", None, line(4), None),
        ("d.log.1.gz", None, line(5), None),
        ("d.log.1.gz", None, None, "EOFError"),
    ]
    lines = spark.createDataFrame(rows, "file string, member string, value string, read_error string")
    kept = quality.file_gate(
        parse_lines(lines), keys=("file", "member"), broadcast_bytes=broadcast_bytes
    )
    assert sorted(r.nanos for r in kept.collect()) == [1, 4]
    assert "read_error" not in kept.columns


def test_gate_plan_is_one_scan_without_shuffle(mixed):
    kept = quality.file_gate(parse_lines(mixed))
    plan = kept._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning(file" not in plan.split("== Physical Plan ==")[1]


def test_report(spark):
    lines = file_lines(
        spark,
        {
            "a.log": [line(1), line(2), "{}", "junk"],
            "b.log": [line(1), "", "null", "junk", '"x"'],
            "c.log": [line(1)],
            "d.log": ["junk"],
        },
    )
    report = quality.file_report(parse_lines(lines))
    rows = {r.file: tuple(r)[1:] for r in report.collect()}
    assert rows == {"a.log": (4, 1, 2), "b.log": (5, 3, 1), "c.log": (1, 0, 1), "d.log": (1, 1, 0)}
    ratio = quality.with_error_ratio(quality.mixed_files(report))
    ordered = quality.sort_report(ratio, by="ratio").collect()
    assert [(r.file, r.parsed_lines, r.error_percent) for r in ordered] == [
        ("a.log", 3, 25.0),
        ("b.log", 2, 60.0),
    ]
    assert [r.file for r in quality.sort_report(report).collect()] == sorted(rows)
    with pytest.raises(ValueError):
        quality.sort_report(report, by="size")


def test_line_counts(spark):
    lines = lines_df(spark, ["a", "", "level 12", "b"])
    assert quality.line_counts(lines).first().lines == 3
    assert quality.line_counts(lines, count_empty=True).first().lines == 4
    assert quality.matching_line_counts(lines, "[0-9]{2}").first().lines == 1


def test_sort_and_unique(spark):
    texts = [line(i % 7, f"s{i % 3}") for i in range(60)]
    texts += ['{"timestamp":"1520983801.999999999"}', '{"timestamp":"2018-03-13T23:30:02.0000000035Z"}']
    entries = usable_entries(lines_df(spark, texts)).repartition(5)
    instants = [(r.epoch_sec, r.nanos) for r in combine.sort_by_time(entries).collect()]
    assert len(instants) == 62 and instants == sorted(instants)
    unique = combine.unique_by_time(entries).collect()
    assert len(unique) == len({tuple(r[f] for f in FIELDS) for r in unique}) == 23
    assert [(r.epoch_sec, r.nanos) for r in unique] == sorted((r.epoch_sec, r.nanos) for r in unique)
    assert unique[0].level_name == "debug" and unique[0].timestamp is not None


def test_sort_is_repeatable(spark):
    texts = [line(i % 2, f"s{i}") for i in range(40)]
    once = usable_entries(lines_df(spark, texts))
    orders = [
        [r.source for r in combine.sort_by_time(once.repartition(n)).collect()] for n in (1, 3, 7)
    ]
    assert orders[0] == orders[1] == orders[2]


def test_unique_is_a_hash_aggregate(spark):
    plan = combine.unique_fields(usable_entries(lines_df(spark, [line()])))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_same_entry(spark):
    v1 = line(5, "rep", 1)
    v2 = v1.replace('"1520983802.000000005"', '"2018-03-13T23:30:02.000000005Z"').replace(
        '"log_level":1', '"level":"info"'
    )
    other = v2.replace("info", "error")
    pairs = spark.createDataFrame([(v1, v2, True), (v1, other, False)], "a string, b string, want boolean")
    left = usable_entries(pairs.select("want", F.col("a").alias("value")))
    right = usable_entries(pairs.select("want", F.col("b").alias("value")))
    joined = left.alias("a").join(right.alias("b"), F.col("a.want") == F.col("b.want"))
    for row in joined.select(F.col("a.want"), combine.same_entry("a", "b").alias("same")).collect():
        assert row.same is row.want


def test_merge_fills_missing_columns(spark):
    merged = combine.merge(
        [spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")]
    )
    assert sorted(map(tuple, merged.collect())) == [(1, None), (2, "x")]


def test_session_helpers(spark):
    folder = shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(folder)
    assert cut_lineage(spark.range(3)).count() == 3
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4
    assert spread(spark.range(0, 100, 1, 9), files=9).rdd.getNumPartitions() == 9


def test_more_rows_make_more_tasks_not_longer_ones(spark, tmp_path):
    rows = spark.range(0, 410_000, 1, 2).withColumnRenamed("id", "event_id")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    dealt = events(spark, str(tmp_path))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 410_000 and len(sizes) == 9 and max(sizes) <= 50_000
    rows.limit(10).write.parquet(f"{tmp_path}/few/events.parquet")
    assert events(spark, f"{tmp_path}/few").rdd.getNumPartitions() == 4


def test_gate_counts_hash_lines_and_sort_only_files(spark):
    rows = [("a", "lager", None), ("a", "raw", None), ("a", "raw", "E: 1"), ("a", None, "E: 2"), ("b", "lager", None), (None, "raw", None)]
    entries = spark.createDataFrame(rows, "file string, kind string, read_error string")
    counts = quality.gate_counts(entries)
    got = {r.file: (r.usable_lines, r.bad_lines, r.failed, r.read_error) for r in counts.collect()}
    assert got == {"a": (1, 1, True, "E: 2"), "b": (1, 0, False, None), None: (0, 1, False, None)}
    # Below the lowest exchange stands what is done to every line.
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.rindex("Exchange") :] and "HashAggregate" in plan[plan.rindex("Exchange") :]
