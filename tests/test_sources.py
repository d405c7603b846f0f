import bz2
import gzip
import io
import lzma
import os
import tarfile
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from samples import block, line

from logspark.operators.parse import usable_entries
from logspark.plans.combine import (
    StagedTables,
    combine_job,
    combine_logs,
    quality_report,
    read_one_file,
    read_tree,
    staged,
)
from logspark.plans.sample_files import NO_UNIT, UNIT_FILE_NAMES, write_unit_files
from logspark.sources import archives
from logspark.sources.files import locate
from logspark.sources.lines import FileSelection, read_lines


def put(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)


def tar(mode, members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as out:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("dir/link.log")
        link.type, link.linkname = tarfile.SYMTYPE, "m.log"
        out.addfile(link)
    return buffer.getvalue()


MEMBERS = [
    ("dir/m.log", block(4, "m")),
    ("dir/empty.log", b""),
    ("dir/.hidden.log", block(1, "hidden")),
    ("dir/g.log.1.gz", gzip.compress(block(7, "g"))),
    ("dir/other.txt", block(3, "other")),
    ("in.tgz", tar("w:gz", [("x.log", block(3, "inner"))])),
    ("in.tar", tar("w", [("deep.tar", tar("w", [("y.log", block(2, "deep"))]))])),
]
EXPECTED = {"m": 4, "hidden": 1, "g": 7, "inner": 3, "deep": 2}


def values(df):
    return sorted(r.value for r in df.select("value").collect())


def sources(df):
    return {r.source: r["count"] for r in df.groupBy("source").count().collect()}


def test_line_rules(spark, tmp_path):
    put(tmp_path / "a.txt", b"one\r\n\n\ntwo\rstill two\nlast without end")
    assert values(read_lines(spark, str(tmp_path))) == ["last without end", "one\r", "two\rstill two"]
    assert read_lines(spark, str(tmp_path), keep_empty=True).count() == 5
    put(tmp_path / "b.txt", b"\x1b[1mx\x1b[0m\n\x1b[1m\x1b[0m\n")
    assert "x" in values(read_lines(spark, str(tmp_path / "b.txt"), strip=True))


@pytest.fixture
def tree(tmp_path):
    put(tmp_path / "a.log", block(1, "a"))
    put(tmp_path / "sub" / "b.log.1.gz", gzip.compress(block(2, "b")))
    put(tmp_path / "sub" / "c.log.gz", gzip.compress(block(3, "c")))
    put(tmp_path / "sub" / "deep" / "d.log", block(4, "d"))
    put(tmp_path / "sub" / "deep" / "e.txt", block(5, "e"))
    put(tmp_path / "f.bz2", bz2.compress(block(6, "f")))
    put(tmp_path / ".hidden.log", block(7, "h"))
    put(tmp_path / ".dir" / "i.log", block(8, "i"))
    put(tmp_path / "j.tar.gz", tar("w:gz", [("k.log", block(9, "k"))]))
    return tmp_path


SELECTIONS = [
    (FileSelection(), {"a": 1, "b": 2, "d": 4}),
    (FileSelection(all_files=True), {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}),
    (FileSelection(include=["*.txt", "a*"]), {"a": 1, "e": 5}),
    (FileSelection(exclude=["[ad].log"]), {"b": 2}),
    (FileSelection(exclude_dir=["de?p"]), {"a": 1, "b": 2}),
    (FileSelection(exclude_dir=["sub"]), {"a": 1}),
]


@pytest.mark.parametrize("selection, expected", SELECTIONS)
def test_file_selection(spark, tree, selection, expected):
    lines = read_lines(spark, str(tree), selection=selection, skip=["*.tar.gz"])
    assert sources(usable_entries(lines)) == expected
    whole = read_tree(spark, str(tree), selection=selection)
    from_tar = {} if selection.include else {"k": 9}
    assert sources(usable_entries(whole)) == expected | from_tar


def test_root_name_is_not_excluded(spark, tree):
    lines = read_lines(spark, str(tree / "sub"), selection=FileSelection(exclude_dir=["sub"]))
    assert sources(usable_entries(lines)) == {"b": 2, "d": 4}


def test_name_filter_prunes_files(spark, tree):
    selection = FileSelection(include=["a.log"])
    plan = read_lines(spark, str(tree), selection=selection)
    plan.collect()
    assert "file_name" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        FileSelection(include=["a["])


def test_xz_and_odd_suffixes(spark, tmp_path):
    for suffix, pack in (("xz", lzma.compress), ("bz", bz2.compress), ("tbz", bz2.compress),
                         ("tbz2", bz2.compress)):
        put(tmp_path / f"x.{suffix}", pack(block(5, suffix)))
    lines = archives.read_streamed(spark, str(tmp_path))
    assert sources(usable_entries(lines)) == {"xz": 5, "bz": 5, "tbz": 5, "tbz2": 5}
    put(tmp_path / "y.gz", gzip.compress(block(5, "xz")))
    same = values(read_lines(spark, str(tmp_path / "y.gz")))
    assert values(read_one_file(spark, str(tmp_path / "x.xz"))) == same


@pytest.mark.parametrize("name, mode", [("t.tar", "w"), ("t.tgz", "w:gz"), ("t.tar.gz", "w:gz")])
def test_archives(spark, tmp_path, name, mode):
    put(tmp_path / name, tar(mode, MEMBERS))
    entries = combine_logs(spark, str(tmp_path / name))
    assert sources(entries) == EXPECTED
    members = {r.member for r in entries.select("member").distinct().collect()}
    assert {"dir/m.log", "in.tgz!x.log", "in.tar!deep.tar!y.log"} <= members


def test_tar_members_read_in_pieces(spark, tmp_path):
    texts = [line(i, "x" * (i % 50)) for i in range(2000)] + ["", "y" * 30_000, "", ""]
    texts += [line(i) for i in range(2000, 2100)]
    put(tmp_path / "t.tar", tar("w", [("a.log", "\n".join(texts).encode()), ("b.log", b"z\n")]))
    expected = sorted([t for t in texts if t] + ["z"])
    for size in (100, 4096, 5000, 1 << 30):
        lines = archives.read_streamed(
            spark, str(tmp_path), selection=FileSelection(), piece_bytes=size
        ).cache()
        assert values(lines) == expected, size
        assert lines.select("member", "position").distinct().count() == len(expected)


def test_lines_are_dealt_out_for_large_files(spark, tmp_path):
    put(tmp_path / "a.xz", lzma.compress(block(100)))
    narrow = archives.read_streamed(spark, str(tmp_path), archives=False)
    wide = archives.read_streamed(spark, str(tmp_path), archives=False, deal_out_bytes=1)
    assert narrow.rdd.getNumPartitions() == 1 and wide.rdd.getNumPartitions() == 4
    assert values(narrow) == values(wide)


def truncated_gzip(rows):
    body = b"".join(line(i, os.urandom(8).hex()).encode() + b"\n" for i in range(rows))
    packed = gzip.compress(body)
    return packed[: len(packed) // 2]


def test_damaged_files(spark, tmp_path):
    put(tmp_path / "ok.log", block(3, "ok"))
    put(tmp_path / "cut.log.1.gz", truncated_gzip(50_000))
    put(tmp_path / "fake.log.1.gz", b"not a gzip file")
    put(tmp_path / "good.log.1.gz", gzip.compress(block(2, "good")))
    put(tmp_path / "members.tar", tar("w", [("cut.log.1.gz", truncated_gzip(5000)), ("m.log", block(4, "m"))]))
    good = {"ok": 3, "good": 2, "m": 4}
    assert sources(combine_logs(spark, str(tmp_path))) == good
    lines = read_tree(spark, str(tmp_path))
    assert sources(usable_entries(archives.complete_files(lines))) == good
    assert sources(usable_entries(archives.complete_files(lines, broadcast_bytes=0))) == good
    faults = {(os.path.basename(r.file), r.member) for r in archives.read_faults(lines).collect()}
    assert faults == {("cut.log.1.gz", None), ("fake.log.1.gz", None), ("members.tar", "cut.log.1.gz")}
    kept = read_lines(spark, str(tmp_path), keep_truncated=True, selection=FileSelection())
    assert kept.count() > 5
    with pytest.raises(Exception):
        read_tree(spark, str(tmp_path), on_error="fail").collect()


@pytest.mark.parametrize("cut", ["header", "body", "garbage"])
@pytest.mark.parametrize("name, mode", [("t.tar", "w"), ("t.tgz", "w:gz")])
def test_damaged_archives(spark, tmp_path, name, mode, cut):
    plain = tar("w", [("a.log", block(20, "a")), ("b.log", block(2000, "b"))])
    second = plain.index(b"b.log\0")
    body = {
        "header": plain[: second + 100],
        "body": plain[: second + 2000],
        "garbage": plain[:second] + b"\xff" * 512 + plain[second + 512 :],
    }[cut]
    put(tmp_path / name, gzip.compress(body) if mode == "w:gz" else body)
    put(tmp_path / "ok.log", block(3, "ok"))
    with pytest.raises(Exception):
        combine_logs(spark, str(tmp_path)).collect()
    assert sources(combine_logs(spark, str(tmp_path), on_archive_error="drop")) == {"ok": 3}


def test_combine_single_file_has_no_gate(spark, tmp_path):
    put(tmp_path / "any.name", b"junk\n" * 200 + block(3))
    assert combine_logs(spark, str(tmp_path / "any.name")).count() == 3
    put(tmp_path / "x.log", b"junk\n" * 200 + block(3))
    put(tmp_path / "y.log", b"junk\n" * 99 + block(4, start=10))
    assert combine_logs(spark, [str(tmp_path / "x.log"), str(tmp_path / "y.log")]).count() == 4


def test_combine_orders_and_removes_copies(spark, tmp_path):
    put(tmp_path / "a.log", block(30, start=10) + block(5, start=5))
    put(tmp_path / "b" / "b.log.1.gz", gzip.compress(block(20, start=0)))
    put(tmp_path / "c.tar", tar("w", [("c.log", block(3, start=100))]))
    rows = combine_logs(spark, str(tmp_path)).collect()
    assert len(rows) == 58 and [r.nanos for r in rows] == sorted(r.nanos for r in rows)
    unique = combine_logs(spark, str(tmp_path), unique=True, where=F.col("nanos") < 20).collect()
    assert [r.nanos for r in unique] == list(range(20))
    again = combine_logs(spark, [str(tmp_path), str(tmp_path / "c.tar")], sort=False)
    assert again.count() == 61


def test_staged_lines(spark, tmp_path):
    put(tmp_path / "a.log", block(30) + b"junk\n")
    tables = StagedTables()
    lines = read_tree(spark, str(tmp_path))
    rows = staged(lines, where=F.col("nanos") < 3, tables=tables)
    assert rows.where("kind = 'lager'").count() == 30 and rows.count() == 31
    assert rows.where("wanted").count() == rows.where("message is not null").count() == 3
    folder = tables.paths[0].removeprefix("file:")
    assert os.path.isdir(folder)
    tables.release()
    assert not os.path.exists(folder)


MIXED = block(50, "mixed") + b"junk\n" * 60


def test_readings_of_one_name_are_gated_apart(spark, tmp_path):
    put(tmp_path / "e" / "app.log", MIXED)
    root = str(tmp_path / "e")
    assert combine_logs(spark, [root, root]).count() == 100
    assert combine_logs(spark, [root, str(tmp_path)]).count() == 100
    for name, mode in (("t.tar", "w"), ("t.tgz", "w:gz")):
        put(tmp_path / name, tar(mode, [("app.log", MIXED), ("app.log", MIXED)]))
        assert combine_logs(spark, str(tmp_path / name)).count() == 100
    nested = tar("w", [("in.tar", tar("w", [("app.log", MIXED)])), ("in.tar", tar("w", [("app.log", MIXED)]))])
    put(tmp_path / "n" / "n.tar", nested)
    assert combine_logs(spark, str(tmp_path / "n")).count() == 100


def test_paths_are_compared_as_they_are(spark, tmp_path):
    base = tmp_path / "my logs" / "100%25 é+x"
    put(base / "a b.log", block(5, "a"))
    put(base / "sub dir" / "c+d.log", block(3, "c"))
    put(base / "é%41.log.1.gz", gzip.compress(block(2, "e")))
    def read(**how):
        return sources(combine_logs(spark, str(base), selection=FileSelection(**how)))
    assert read() == {"a": 5, "c": 3, "e": 2}
    assert read(include=["a b.log"]) == {"a": 5}
    assert read(include=["é%41*", "c+d.log"]) == {"c": 3, "e": 2}
    assert read(exclude_dir=["sub dir"]) == {"a": 5, "e": 2}
    assert read(exclude_dir=["my logs", "100*"]) == {"a": 5, "c": 3, "e": 2}
    files = {r.file for r in combine_logs(spark, str(base)).select("file").distinct().collect()}
    assert {f.removeprefix("file:").replace("//", "/") for f in files} == {
        str(base / n) for n in ("a b.log", "sub dir/c+d.log", "é%41.log.1.gz")
    }


def test_underscore_names_are_read(spark, tmp_path):
    put(tmp_path / "_x.log", block(50, "x"))
    put(tmp_path / "y.log", block(1, "y"))
    put(tmp_path / "_dir" / "z.log.1.gz", gzip.compress(block(2, "z")))
    put(tmp_path / "_dir" / ".z.log", block(9, "hidden"))
    put(tmp_path / ".dir" / "_z.log", block(9, "hidden"))
    put(tmp_path / "_t.tar", tar("w", [("m.log", block(4, "m"))]))
    assert sources(combine_logs(spark, str(tmp_path))) == {"x": 50, "y": 1, "z": 2, "m": 4}
    selection = FileSelection(exclude=["_x*"], exclude_dir=["_dir"])
    assert sources(combine_logs(spark, str(tmp_path), selection=selection)) == {"y": 1, "m": 4}
    small = archives.read_underscored(spark, str(tmp_path), selection=FileSelection(include=["_x.log"]), piece_bytes=64)
    assert sources(usable_entries(small)) == {"x": 50, "m": 4} or sources(usable_entries(small)) == {"x": 50}


def test_single_file_options(spark, tmp_path):
    colored = block(1).replace(b'"source":"', b'"source":"\x1b[1m')
    put(tmp_path / "c.log", colored)
    assert combine_logs(spark, str(tmp_path / "c.log")).count() == 0
    assert combine_logs(spark, str(tmp_path / "c.log"), strip=True).count() == 1
    body = b"".join(line(i, os.urandom(8).hex()).encode() + b"\n" for i in range(20_000))
    packed = lzma.compress(body)
    put(tmp_path / "broken.xz", packed[: len(packed) // 2])
    with pytest.raises(Exception):
        combine_logs(spark, str(tmp_path / "broken.xz")).collect()
    assert combine_logs(spark, str(tmp_path / "broken.xz"), on_error="keep_prefix").count() > 0
    put(tmp_path / "cut.gz", truncated_gzip(20_000))
    with pytest.raises(Exception):
        combine_logs(spark, str(tmp_path / "cut.gz")).collect()


def test_only_damage_drops_a_file():
    def failing(error):
        yield from ()
        raise error

    for error in (gzip.BadGzipFile("x"), EOFError("x"), lzma.LZMAError("x"), OSError("Invalid data stream")):
        (batch,) = archives._guarded(failing(error), "f", None, None, False)
        assert batch.to_pylist()[0]["read_error"]
        with pytest.raises(type(error)):
            list(archives._guarded(failing(error), "f", None, None, True))
    for error in (ConnectionError("lost"), OSError("throttled"), TimeoutError()):
        with pytest.raises(OSError):
            list(archives._guarded(failing(error), "f", None, None, False))


def test_files_that_cannot_be_opened_are_reported():
    read = archives._read_stream_files(lambda name: True, True, False)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"path": ["file:/no/such/file.log.1.gz"]})
    (found,) = read([batch])
    assert found.to_pylist()[0]["read_error"].startswith("FileNotFoundError")


def test_job_tells_what_it_left_out(spark, tmp_path):
    put(tmp_path / "ok.log", block(3, "ok"))
    put(tmp_path / "junk.log", b"junk\n" * 5)
    put(tmp_path / "poor.log", block(3) + b"junk\n" * 100)
    put(tmp_path / "cut.log.1.gz", b"not a gzip file")
    put(tmp_path / "t.tgz", tar("w:gz", [("m.log", block(2)), ("m.log", b"junk\n")]))
    job = combine_job(spark, str(tmp_path))
    rows = [
        (os.path.basename(r.file), r.member, r.usable_lines, r.bad_lines, r.read_error is not None, r.kept)
        for r in job.files.collect()
    ]
    assert sorted(rows, key=str) == sorted(
        [
            ("ok.log", None, 3, 0, False, True),
            ("junk.log", None, 0, 5, False, False),
            ("poor.log", None, 3, 100, False, False),
            ("cut.log.1.gz", None, 0, 0, True, False),
            ("t.tgz", "m.log", 2, 0, False, True),
            ("t.tgz", "m.log", 0, 1, False, False),
        ],
        key=str,
    )
    assert job.entries.count() == 5
    job.release()


def test_tasks_follow_the_bytes():
    assert archives.tar_tasks(10, 8) == 8
    assert archives.tar_tasks(100 << 40, 1000) == (100 << 40) // (2 * archives.PIECE_BYTES)


def test_index_comes_in_batches(tmp_path):
    import pyarrow as pa
    put(tmp_path / "t.tar", tar("w", [(f"{i}.log", b"x\n") for i in range(10_050)]))
    index = archives._index_tar(lambda name: True, True, 1 << 20)
    batches = list(index([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "t.tar")]})]))
    assert [b.num_rows for b in batches] == [10_000, 50]


def test_schemes(tmp_path):
    system, inner = locate(f"file://{tmp_path}/a%20b")
    assert inner == f"{tmp_path}/a%20b" and locate(str(tmp_path))[1] == str(tmp_path)
    for path in ("dbfs:/x/y", "abfs://c@h/x"):
        with pytest.raises(ValueError, match="scheme"):
            locate(path)
    system, inner = locate("s3a://bucket/a b", {"region": "eu-west-1"})
    assert system.type_name == "s3" and inner == "bucket/a b" and system.region == "eu-west-1"


def test_quality_report(spark, tmp_path):
    put(tmp_path / "a.log", block(3) + b"junk\n\n")
    put(tmp_path / "b.log", block(9) + b"junk\n")
    put(tmp_path / "c.log", block(2))
    put(tmp_path / "d.txt", b"junk\n" + block(2))
    rows = quality_report(spark, str(tmp_path)).collect()
    assert [(os.path.basename(r.file), r.total_lines, r.error_percent) for r in rows] == [
        ("b.log", 10, 10.0),
        ("a.log", 5, 40.0),
    ]


def tasks_of(spark, run):
    """Number of tasks that a call starts."""
    context, tracker, group = spark.sparkContext, spark.sparkContext.statusTracker(), uuid.uuid4().hex
    context.setJobGroup(group, "")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return sum(tracker.getStageInfo(s).numTasks for s in stages)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(60):
        put(tmp_path / f"unit={n}" / "a.log", b"x\n")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    most = 8 * spark.sparkContext.defaultParallelism
    assert 0 < tasks_of(spark, lambda: read_lines(spark, str(tmp_path))) <= most < 60
    assert spark.conf.get(name) == before
    assert read_lines(spark, str(tmp_path)).count() == 60


def test_names_are_tested_by_one_pattern_each_for_what_is_read_and_skipped(spark, tmp_path):
    names = ["part-1", "part-2.gz", "part-3.tar", "part 4+é%", "part-5.bz", "x", "part-6"]
    for name in names:
        put(tmp_path / "d" / name, b"x\n")
    selection = FileSelection(include=["part*", "y"], exclude=["*-6", "*-7"])
    lines = read_lines(spark, str(tmp_path), selection=selection, skip=["*.tar", "*.gz", "*.bz"])
    assert {os.path.basename(r.file) for r in lines.collect()} == {"part-1", "part 4+é%"}
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 3


def test_unit_files_are_one_small_file_each(spark, tmp_path):
    """No committer's files and no checksums beside them; every line once for each codec."""
    ids = spark.range(0, 30_000, 1, 5).withColumn("unit", F.concat(F.lit("u-"), (F.col("id") % 300).cast("string")))
    odd = spark.createDataFrame([(None, "no unit"), ("u-7", None), (None, "again")], "unit string, value string")
    lines = ids.select("unit", F.concat(F.lit("line "), "id").alias("value")).unionByName(odd)
    folder = str(tmp_path / "units")
    assert write_unit_files(lines, folder, "none", "gzip") == 30_003
    expected = {f"{codec}/unit={unit}/{name}" for codec, name in UNIT_FILE_NAMES.items() for unit in [NO_UNIT, *(f"u-{i}" for i in range(300))]}
    assert {str(p.relative_to(folder)) for p in (tmp_path / "units").rglob("*") if p.is_file()} == expected
    unit = F.regexp_extract("file", "unit=([^/]+)", 1).alias("unit")
    written = lines.where("value is not null").select(F.coalesce("unit", F.lit(NO_UNIT)).alias("unit"), "value")
    for codec in ("none", "gzip"):
        read = read_lines(spark, f"{folder}/{codec}").select(unit, "value")
        assert read.count() == 30_002 and read.exceptAll(written).isEmpty()
    assert write_unit_files(lines.limit(0), f"{folder}-empty", "none") == 0
    assert read_lines(spark, f"{folder}-empty").isEmpty()


def test_tree_query_writes_unit_files(spark, tmp_path, monkeypatch):
    """The folder of combine_tree holds one file for each block and codec, and nothing beside."""
    from logspark.plans import queries

    rows = spark.sql(
        "select id event_id, timestamp_ntz'2024-01-01 00:00:00' ts, id % 50 user_id, 'click' event_type, 1.5D value, '{}' props from range(3000)"
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    folder = queries._unit_files(spark, str(tmp_path), "none", "gzip")
    found = sorted(p.name for p in Path(folder).rglob("*") if p.is_file())
    # 3,000 events are two blocks of three files and a part of one that has one.
    assert found == ["part-0.txt"] * 7 + ["part-0.txt.gz"] * 7
