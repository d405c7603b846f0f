"""Write derived log lines as the kinds of files the sources read.

Each task writes its own partition, one Arrow batch at a time, into a folder all
executors reach. File names follow from the partition number or the unit, so a task that
runs again overwrites what it wrote before.
"""

from __future__ import annotations

import gzip
import io
import lzma
import tarfile
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.session import ship_package
from logspark.sources.files import locate

# File kinds: name pattern by partition number.
FILE_NAMES = {
    "log": "app-{}.log",
    "gz": "app-{}.log.1.gz",
    "xz": "app-{}.log.xz",
    "tar": "bundle-{}.tar",
    "tgz": "bundle-{}.tgz",
    "nested": "outer-{}.tar",
    "repeats": "again-{}.tar",
    "damaged": "broken-{}.log.1.gz",
    "underscore": "_app-{}.log",
    "dot": ".app-{}.log",
}

# Name of the file of a unit by codec.
UNIT_FILE_NAMES = {"none": "part-0.txt", "gzip": "part-0.txt.gz"}
# What Spark calls the folder of a NULL.
NO_UNIT = "__HIVE_DEFAULT_PARTITION__"


def _output(folder: str, name: str):
    system, inner = locate(folder)
    system.create_dir(inner, recursive=True)
    return system.open_output_stream(f"{inner}/{name}", compression=None)


def _add(tar: tarfile.TarFile, name: str, body: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(body)
    tar.addfile(info, io.BytesIO(body))


def _inner_tar(name: str, body: bytes) -> bytes:
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        _add(tar, name, body)
    return buffer.getvalue()


def write_files(lines: DataFrame, folder: str, kind: str) -> int:
    """Write ``value`` lines as files of one kind; gives the number of lines."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        with ExitStack() as stack:
            out = stack.enter_context(_output(folder, FILE_NAMES[kind].format(part)))
            if kind == "damaged":  # bytes after the gzip stream are a fault
                stack.callback(out.write, b"broken")
            if kind in ("gz", "damaged"):
                out = stack.enter_context(gzip.GzipFile(fileobj=out, mode="wb"))
            elif kind == "xz":
                out = stack.enter_context(lzma.LZMAFile(out, mode="wb"))
            elif kind in ("tar", "tgz", "nested", "repeats"):
                mode = "w|gz" if kind == "tgz" else "w|"
                out = stack.enter_context(tarfile.open(fileobj=out, mode=mode))
            for number, batch in enumerate(batches):
                body = _text(batch)
                count += batch.num_rows
                if kind in ("tar", "tgz"):
                    _add(out, f"logs/part-{number}.log", body)
                elif kind == "repeats":  # one name for all members
                    for first in range(0, batch.num_rows, 1000):
                        _add(out, "logs/app.log", _text(batch.slice(first, 1000)))
                elif kind == "nested":
                    _add(out, f"inner-{number}.tgz", _inner_tar("deep/x.log", body))
                else:
                    out.write(body)
        yield pa.RecordBatch.from_pydict({"n": [count]})

    ship_package(lines.sparkSession)
    written = lines.select("value").mapInArrow(write, "n bigint")
    return written.groupBy().sum("n").first()[0]


def write_unit_files(lines: DataFrame, folder: str, *codecs: str) -> int:
    """Write ``value`` lines as a text file for each ``unit`` and codec; gives the number of lines.

    Files are ``codec/unit=.../part-0.txt`` below the folder. The lines of a unit meet in one
    task, which sorts by unit and has the files of one unit open at a time. Spark's own writer
    makes the same files, but on a local disk starts a process for each to set its permissions,
    which takes many times as long as a small file itself.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, current, outs = 0, None, []
        with ExitStack() as stack:
            for batch in batches:
                first = 0
                for unit, run in groupby(batch.column("unit").to_pylist()):
                    if unit != current:
                        stack.close()
                        current = unit
                        outs = [stack.enter_context(_unit_output(folder, codec, unit)) for codec in codecs]
                    rows = sum(1 for _ in run)
                    body = _text(batch.slice(first, rows))
                    for out in outs:
                        out.write(body)
                    first += rows
                count += first
        yield pa.RecordBatch.from_pydict({"n": [count]})

    ship_package(lines.sparkSession)
    for codec in codecs:  # also if there are no lines
        system, inner = locate(f"{folder}/{codec}")
        system.create_dir(inner, recursive=True)
    unit, value = F.coalesce("unit", F.lit(NO_UNIT)).alias("unit"), F.coalesce("value", F.lit("")).alias("value")
    dealt = lines.select(unit, value).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(write, "n bigint").groupBy().sum("n").first()[0] or 0


def _unit_output(folder: str, codec: str, unit: str):
    system, inner = locate(f"{folder}/{codec}/unit={unit}")
    system.create_dir(inner, recursive=True)
    packed = "gzip" if codec == "gzip" else None
    return system.open_output_stream(f"{inner}/{UNIT_FILE_NAMES[codec]}", compression=packed)


def _text(batch: pa.RecordBatch) -> bytes:
    return "".join(line + "\n" for line in batch.column("value").to_pylist()).encode()
