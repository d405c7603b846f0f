"""Lines of tar archives and of compressed files Spark has no codec for.

Spark lists the files and packs them into tasks by size; inside a task one file after
the other is streamed through the matching decompressor and leaves as Arrow batches,
so memory does not grow with file size. An uncompressed tar is first indexed by
seeking from header to header, and its members (large ones in pieces) are then spread
over all tasks; compressed tars can only be read from the front, by one task each. Xz files
of several blocks are cut at these.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import tarfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.patterns import glob_matches, glob_matches_any
from logspark.operators.joins import BROADCAST_BYTES, anti_join, key_bytes, salted_anti_join
from logspark.session import cut_lineage, listing_in_few_tasks, scratch_path, ship_package, spread
from logspark.sources import xz_blocks
from logspark.sources.files import open_file
from logspark.sources.listing import underscored_files
from logspark.sources.lines import (
    ARCHIVE_GLOBS,
    GZIP_GLOBS,
    STREAM_GLOBS,
    FileSelection,
    _as_list,
    disjoint_groups,
    union_of_groups,
)

_ERRORS = (OSError, EOFError, zlib.error, lzma.LZMAError, tarfile.TarError)
_DAMAGE = (gzip.BadGzipFile, EOFError, zlib.error, lzma.LZMAError, tarfile.TarError)


def is_damage(error: Exception) -> bool:
    """True for a fault of the file itself; others, such as a lost connection, may pass."""
    # What the bzip2 module raises has no type of its own.
    bzip2 = type(error) is OSError and error.args == ("Invalid data stream",)
    return bzip2 or isinstance(error, _DAMAGE)


def _is_closed(error: Exception) -> bool:
    return isinstance(error, (FileNotFoundError, PermissionError))

CHUNK = 1 << 20

# Size of the pieces a large member of an uncompressed tar is read in, and the size
# from which a file that cannot be split has its lines dealt out to other tasks.
PIECE_BYTES = 64 * CHUNK
DEAL_OUT_BYTES = 256 * CHUNK

# Tasks that the pieces of xz files are dealt out to, at most.
MOST_TASKS = 50_000

# ``stream`` holds where the member stands in its archive (in each archive around it):
# names can repeat in one archive, and each member is judged by itself.
LINE_SCHEMA = (
    "file string, member string, stream string, position bigint, value binary, read_error string"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("member", pa.string()),
        ("stream", pa.string()),
        ("position", pa.int64()),
        ("value", pa.binary()),
        ("read_error", pa.string()),
    ]
)

Batches = Iterator[pa.RecordBatch]


def _decompressed(stream, name: str):
    if name.endswith((".gz", ".tgz")):
        return gzip.GzipFile(fileobj=stream)
    if name.endswith((".bz2", ".bz", ".tbz2", ".tbz")):
        return bz2.BZ2File(stream)
    return lzma.LZMAFile(stream) if name.endswith(".xz") else stream


def _batch(
    file: str, member: str | None, stream: str | None, first: int, lines: list[bytes]
) -> pa.RecordBatch:
    """Non-empty lines with their line numbers, counted from ``first``."""
    kept = [(first + i, line) for i, line in enumerate(lines) if line]
    n = len(kept)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * n, pa.string()),
            pa.array([member] * n, pa.string()),
            pa.array([stream] * n, pa.string()),
            pa.array([p for p, _ in kept], pa.int64()),
            pa.array([v for _, v in kept], pa.binary()),
            pa.nulls(n, pa.string()),
        ],
        schema=_ARROW,
    )


def _error(file: str, member: str | None, at: str | None, error: Exception) -> pa.RecordBatch:
    row = {"file": file, "member": member, "stream": at, "read_error": f"{type(error).__name__}: {error}"}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _line_batches(stream, file: str, member: str | None, at: str | None) -> Batches:
    """Split a byte stream at newlines, one batch per chunk."""
    rest: list[bytes] = []
    number = 1
    while chunk := stream.read(CHUNK):
        head, newline, tail = chunk.rpartition(b"\n")
        if not newline:
            rest.append(chunk)
            continue
        lines = (b"".join(rest) + head).split(b"\n")
        yield _batch(file, member, at, number, lines)
        number += len(lines)
        rest = [tail]
    if last := b"".join(rest):
        yield _batch(file, member, at, number, [last])


def _guarded(batches: Batches, file: str, member: str | None, at: str | None, fail: bool) -> Batches:
    """Turn damage into an error row, which later drops the whole file.

    Other faults fail the task, so that Spark tries it again.
    """
    try:
        yield from batches
    except _ERRORS as e:
        if fail or not is_damage(e):
            raise
        yield _error(file, member, at, e)


def _is(name: str, globs: Iterable[str]) -> bool:
    return any(glob_matches(name.rpartition("/")[2], g) for g in globs)


class _StrictMember(tarfile.TarInfo):
    """Tar header that reports damage anywhere, not only at the start of an archive."""

    @classmethod
    def fromtarfile(cls, tar):
        try:
            return super().fromtarfile(tar)
        except (tarfile.InvalidHeaderError, tarfile.TruncatedHeaderError) as e:
            raise tarfile.ReadError(str(e)) from e


def _members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """Regular, non-empty members; headers already passed are not kept in memory."""
    for info in tar:
        tar.members = []
        if info.isreg() and info.size:
            yield info


def _tar_batches(
    stream, file: str, prefix: str, around: str, name_ok: Callable[[str], bool], fail_file: bool
) -> Batches:
    """Lines of every regular, non-empty member of a tar stream; nested tars open up."""
    with tarfile.open(fileobj=stream, mode="r|", tarinfo=_StrictMember) as tar:
        for info in _members(tar):
            member, at = f"{prefix}{info.name}", f"{around}{info.offset}"
            if _is(info.name, ARCHIVE_GLOBS):
                inner = _decompressed(tar.extractfile(info), info.name)
                yield from _tar_batches(inner, file, f"{member}!", f"{at}!", name_ok, fail_file)
            elif name_ok(info.name):
                body = tar.extractfile(info)
                body = _decompressed(body, info.name) if _is(info.name, GZIP_GLOBS) else body
                lines = _line_batches(body, file, member, at)
                yield from _guarded(lines, file, member, at, fail_file)


def _read_stream_files(name_ok: Callable[[str], bool], fail: bool, fail_file: bool):
    """Task body: whole files, from the front.

    ``fail`` is about broken archives, ``fail_file`` about other files and members.
    """
    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from one_file(path)

    def one_file(path: str) -> Batches:
        try:
            with open_file(path) as raw:
                stream = _decompressed(raw, path)
                if _is(path, ARCHIVE_GLOBS):
                    yield from _tar_batches(stream, path, "", "", name_ok, fail_file)
                else:
                    lines = _line_batches(stream, path, None, None)
                    yield from _guarded(lines, path, None, None, fail_file)
        except _ERRORS as e:
            strict = fail if _is(path, ARCHIVE_GLOBS) else fail_file
            if strict or not (is_damage(e) or _is_closed(e)):
                raise
            yield _error(path, None, None, e)

    return read


_PIECE_SCHEMA = (
    "file string, member string, at string, start bigint, stop bigint, lo bigint, hi bigint, "
    "nested boolean, read_error string"
)


def _index_tar(name_ok: Callable[[str], bool], fail: bool, piece_bytes: int):
    """Task body: list the members of seekable tars as byte ranges, without reading them."""
    def rows(path: str) -> Iterator[dict]:
        base = {"file": path, "member": None, "at": None, "start": None, "stop": None, "lo": None, "hi": None,
                "nested": None, "read_error": None}
        try:
            with (
                open_file(path) as raw,
                tarfile.open(fileobj=raw, mode="r:", tarinfo=_StrictMember) as tar,
            ):
                end = raw.size()
                for info in _members(tar):
                    nested = _is(info.name, ARCHIVE_GLOBS)
                    if not nested and not name_ok(info.name):
                        continue
                    start, stop = info.offset_data, info.offset_data + info.size
                    if stop > end:
                        raise tarfile.ReadError("unexpected end of data")
                    whole = nested or _is(info.name, GZIP_GLOBS)
                    step = info.size if whole else piece_bytes
                    for lo in range(start, stop, step):
                        yield base | {"member": info.name, "at": str(info.offset), "start": start, "stop": stop, "lo": lo,
                                      "hi": min(lo + step, stop), "nested": nested}
        except _ERRORS as e:
            if fail or not (is_damage(e) or _is_closed(e)):
                raise
            yield base | {"read_error": f"{type(e).__name__}: {e}"}

    schema = pa.schema(
        [("file", pa.string()), ("member", pa.string()), ("at", pa.string())]
        + [(n, pa.int64()) for n in ("start", "stop", "lo", "hi")]
        + [("nested", pa.bool_()), ("read_error", pa.string())]
    )

    def index(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = rows(path)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_pylist(part, schema=schema)

    return index


class _Range:
    """Read-only view of a byte range of an open file."""

    def __init__(self, raw, start: int, stop: int):
        self.raw, self.left = raw, stop - start
        raw.seek(start)

    def read(self, size: int = -1) -> bytes:
        size = self.left if size is None or size < 0 else min(size, self.left)
        data = self.raw.read(size) if size else b""
        if size and not data:
            raise EOFError("unexpected end of data")
        self.left -= len(data)
        return data

    def readable(self) -> bool:
        return True


def _piece_batches(raw, row: dict) -> Batches:
    """Lines that begin inside ``lo..hi`` of a member; the last may run past ``hi``.

    The position of a line is its byte offset in the member.
    """
    lo, hi = row["lo"], row["hi"]
    stream = _Range(raw, max(lo - 1, row["start"]), row["stop"])
    at, buffer = max(lo - 1, row["start"]), b""
    if lo > row["start"]:  # a line that began before `lo` belongs to the piece before
        while True:
            chunk = stream.read(CHUNK)
            if not chunk:
                return
            skipped, newline, buffer = chunk.partition(b"\n")
            at += len(skipped) + len(newline)
            if newline:
                break
    lines: list[tuple[int, bytes]] = []

    def flush() -> pa.RecordBatch:
        n = len(lines)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([row["file"]] * n, pa.string()),
                pa.array([row["member"]] * n, pa.string()),
                pa.array([row["at"]] * n, pa.string()),
                pa.array([p - row["start"] for p, _ in lines], pa.int64()),
                pa.array([v for _, v in lines], pa.binary()),
                pa.nulls(n, pa.string()),
            ],
            schema=_ARROW,
        )
        lines.clear()
        return batch

    while at < hi:
        head, newline, tail = buffer.rpartition(b"\n")
        if newline:
            for line in head.split(b"\n"):
                if at >= hi:
                    break
                if line:
                    lines.append((at, line))
                at += len(line) + 1
            if lines:
                yield flush()
            buffer = tail
            continue
        chunk = stream.read(CHUNK)
        if not chunk:
            if buffer:
                lines.append((at, buffer))
                yield flush()
            return
        parts = [buffer, chunk]
        while b"\n" not in chunk and (chunk := stream.read(CHUNK)):
            parts.append(chunk)
        buffer = b"".join(parts)


def _read_pieces(name_ok: Callable[[str], bool], fail: bool, fail_file: bool):
    """Task body: byte ranges of tar members."""
    def read(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                yield from one_piece(row)

    def one_piece(row: dict) -> Batches:
        file, member = row["file"], row["member"]
        if row["read_error"] is not None:
            error = {"file": file, "read_error": row["read_error"]}
            yield pa.RecordBatch.from_pylist([error], schema=_ARROW)
            return
        try:
            with open_file(file) as raw:
                if row["nested"]:
                    inner = _decompressed(_Range(raw, row["start"], row["stop"]), member)
                    around = f"{row['at']}!"
                    yield from _tar_batches(inner, file, f"{member}!", around, name_ok, fail_file)
                elif member is not None and _is(member, GZIP_GLOBS):
                    body = _decompressed(_Range(raw, row["start"], row["stop"]), member)
                    lines = _line_batches(body, file, member, row["at"])
                    yield from _guarded(lines, file, member, row["at"], fail_file)
                else:
                    yield from _piece_batches(raw, row)
        except _ERRORS as e:
            if fail or not is_damage(e):
                raise
            yield _error(file, None, None, e)

    return read


def _index_xz(piece_bytes: int):
    """Task body: xz files as runs of blocks; one row without numbers for a file to be read whole."""
    def rows(path: str) -> Iterator[dict]:
        try:
            with open_file(path) as raw:
                runs = list(xz_blocks.pieces(xz_blocks.blocks_of(raw, raw.size()), piece_bytes))
        except _ERRORS as e:
            if not (is_damage(e) or _is_closed(e)):
                raise
            runs = []
        if len(runs) < 2:  # or broken: reading from the front tells how far it is sound
            runs = [(None, None)]
        for first, last in runs:
            yield {"path": path, "first": first, "last": last}

    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def index(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = rows(path)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_pylist(part, schema=schema)

    return index


def _read_blocks(fail: bool):
    """Task body: lines of runs of xz blocks; a fault anywhere leaves an error row for the file."""
    def lines(path: str, first: int, last: int) -> Batches:
        with open_file(path) as raw:
            for found in xz_blocks.lines_of(raw, xz_blocks.blocks_of(raw, raw.size()), first, last):
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n, pa.string()),
                        pa.nulls(n, pa.string()),
                        pa.nulls(n, pa.string()),
                        pa.array([p for p, _ in found], pa.int64()),
                        pa.array([v for _, v in found], pa.binary()),
                        pa.nulls(n, pa.string()),
                    ],
                    schema=_ARROW,
                )

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _guarded(lines(row["path"], row["first"], row["last"]), row["path"], None, None, fail)

    return read


def _name_test(selection: FileSelection) -> Callable[[str], bool]:
    wanted, exclude = selection.wanted, tuple(selection.exclude)

    def name_ok(name: str) -> bool:
        return (not wanted or _is(name, wanted)) and not _is(name, exclude)

    return name_ok


def _listing(spark: SparkSession, roots: list[str], globs: Iterable[str]) -> DataFrame:
    """Paths of matching files; only the listing is done, no content is read."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(globs) + "}")
    )
    with listing_in_few_tasks(spark):
        return reader.load(roots)


def read_underscored(
    spark: SparkSession,
    paths: str | Iterable[str],
    *,
    selection: FileSelection | None = None,
    on_archive_error: str = "fail",
    on_file_error: str = "drop",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame | None:
    """Lines of the files whose path has a name starting with ``_``; None without such files.

    Spark's own sources never list them. Plain files are read in pieces by all tasks,
    compressed ones and archives from the front.
    """
    ship_package(spark)
    chosen = selection or FileSelection(all_files=True)
    name_ok, fail, fail_file = _name_test(chosen), on_archive_error == "fail", on_file_error == "fail"
    cores = spark.sparkContext.defaultParallelism
    packed = "|".join(g[1:].replace(".", "[.]") for g in (*ARCHIVE_GLOBS, *STREAM_GLOBS, *GZIP_GLOBS))

    def read(listed: DataFrame, roots: list[str]) -> DataFrame | None:
        name = F.element_at(F.split("path", "/"), -1)
        archive = glob_matches_any(name, ARCHIVE_GLOBS)
        listed = listed.where(archive | chosen.name_filter(name))
        listed = cut_lineage(listed.where(chosen.directory_filter(F.col("path"), roots)))
        size = listed.agg(F.sum("size")).first()[0]
        if size is None:
            return None
        streamed = name.rlike(f"(?:{packed})\\z")
        whole = listed.where(streamed).select("path").repartition(cores)
        lo = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(piece_bytes).cast("bigint")))
        cut = listed.where(~streamed & (F.col("size") > 0)).select("path", "size", lo.alias("lo"))
        pieces = cut.select(
            F.col("path").alias("file"),
            F.lit(None).cast("string").alias("member"),
            F.lit(None).cast("string").alias("at"),
            F.lit(0).cast("bigint").alias("start"),
            F.col("size").alias("stop"),
            "lo",
            F.least("size", F.col("lo") + piece_bytes).alias("hi"),
            F.lit(False).alias("nested"),
            F.lit(None).cast("string").alias("read_error"),
        ).repartition(tar_tasks(size, cores, piece_bytes))
        return whole.mapInArrow(_read_stream_files(name_ok, fail, fail_file), LINE_SCHEMA).unionByName(
            pieces.mapInArrow(_read_pieces(name_ok, fail, fail_file), LINE_SCHEMA)
        )

    tables = []
    for n, roots in enumerate(disjoint_groups(_as_list(paths))):
        lines = read(underscored_files(spark, roots), roots)
        if lines is not None:
            tables.append(lines.withColumn("stream", F.concat(F.lit(f"{n}:"), F.coalesce("stream", F.lit("")))))
    if not tables:
        return None
    return reduce(DataFrame.unionByName, tables).withColumn("value", F.col("value").cast("string"))


def _sizes(files: DataFrame, cut: Column):
    """What the plan for some files depends on."""
    return files.agg(
        F.max("length").alias("largest"), F.sum("length").alias("all"), F.count("*").alias("n"), F.count_if(cut).alias("cut")
    ).first()


def tar_tasks(size: int, cores: int, piece_bytes: int = PIECE_BYTES) -> int:
    """Tasks for so many bytes of tar: one for each two pieces, or one for each core."""
    return max(cores, size // (2 * piece_bytes))


def read_streamed(
    spark: SparkSession,
    paths: str | Iterable[str],
    *,
    selection: FileSelection | None = None,
    archives: bool = True,
    gzip_files: bool = False,
    on_archive_error: str = "fail",
    on_file_error: str = "drop",
    piece_bytes: int = PIECE_BYTES,
    deal_out_bytes: int = DEAL_OUT_BYTES,
) -> DataFrame:
    """Lines of archives, xz and odd-suffix bzip2 files below the given paths.

    Gives ``file, member, stream, position, value, read_error``. A file or member that breaks
    off leaves one row with ``read_error`` set and no value; the lines before the fault
    are in the table too, and :func:`complete_files` or the file gate removes them.
    A broken archive fails the query, or with ``on_archive_error="drop"`` is treated
    the same way. Other broken files fail the query with ``on_file_error="fail"``. Only
    damage counts; a fault of the connection or store fails the task, and Spark tries it
    again. ``gzip_files`` reads plain gzip files here as well, for the same
    handling of faults. An xz file of several blocks is read by tasks of at least
    ``piece_bytes`` of text each, ``position`` then being a line's offset in it; others are
    read from the front, where it is a line number. If the largest file that cannot be split has ``deal_out_bytes``
    or more, or there are fewer tasks than cores, the lines are dealt out evenly before
    they go on.
    """
    if on_archive_error not in ("fail", "drop"):
        raise ValueError(f"on_archive_error must be 'fail' or 'drop', not {on_archive_error!r}")
    if on_file_error not in ("fail", "drop"):
        raise ValueError(f"on_file_error must be 'fail' or 'drop', not {on_file_error!r}")
    ship_package(spark)
    fail_file = on_file_error == "fail"
    chosen = selection or FileSelection(all_files=True)
    name_ok, fail = _name_test(chosen), on_archive_error == "fail"
    cores = spark.sparkContext.defaultParallelism
    name = F.element_at(F.split("path", "/"), -1)
    archive_name = name.rlike(r"\.(tgz|tar\.gz)\z")
    wanted = chosen.name_filter(name) & ~archive_name
    globs = [*STREAM_GLOBS, *(("*.tgz", "*.tar.gz") if archives else ())]
    if gzip_files:
        globs += GZIP_GLOBS

    def whole_files(roots: list[str]) -> DataFrame:
        files = _listing(spark, roots, globs).select("path", "length")
        files = files.where(archive_name | wanted if archives else wanted)
        files = files.where(chosen.directory_filter(F.col("path"), roots))
        # Xz files worth an index, which is at their end; text packs to a tenth or less at times.
        cut = name.rlike(r"(?<!\.tar)\.xz\z") & (F.col("length") >= piece_bytes // 16)
        indexed = files.where(cut).select("path").mapInArrow(_index_xz(piece_bytes), "path string, first bigint, last bigint")
        sizes = _sizes(files, cut)
        if not sizes["cut"]:
            return from_the_front(files, sizes)
        indexed = cut_lineage(indexed)
        runs, whole = indexed.where(F.col("first").isNotNull()), indexed.where(F.col("first").isNull())
        lines = runs.repartition(min(max(runs.count(), 1), MOST_TASKS)).mapInArrow(_read_blocks(fail_file), LINE_SCHEMA)
        rest = files.where(~cut).unionByName(files.where(cut).join(whole.select("path"), "path", "left_semi"))
        return lines.unionByName(from_the_front(rest, _sizes(rest, cut)))

    def from_the_front(files: DataFrame, size) -> DataFrame:
        lines = files.select("path").mapInArrow(_read_stream_files(name_ok, fail, fail_file), LINE_SCHEMA)
        if (size["largest"] or 0) >= deal_out_bytes:
            return lines.repartition(max(cores, size["all"] // PIECE_BYTES))
        return spread(lines, size["n"]) if (size["all"] or 0) > CHUNK else lines

    def tar_pieces(roots: list[str]) -> DataFrame:
        tars = _listing(spark, roots, ["*.tar"])
        tars = tars.where(chosen.directory_filter(F.col("path"), roots))
        size = tars.agg(F.sum("length")).first()[0] or 0
        pieces = tars.select("path").mapInArrow(_index_tar(name_ok, fail, piece_bytes), _PIECE_SCHEMA)
        # Tasks by bytes; pieces are of one size but for nested and compressed members.
        dealt = pieces.repartition(tar_tasks(size, cores, piece_bytes))
        return dealt.mapInArrow(_read_pieces(name_ok, fail, fail_file), LINE_SCHEMA)

    def read(roots: list[str]) -> DataFrame:
        lines = whole_files(roots)
        return lines.unionByName(tar_pieces(roots)) if archives else lines

    lines = union_of_groups(read, _as_list(paths))
    return lines.withColumn("value", F.col("value").cast("string"))


def read_faults(lines: DataFrame) -> DataFrame:
    """The files and members that could not be read to their end."""
    return lines.where(F.col("read_error").isNotNull()).select("file", "member", "read_error")


def complete_files(lines: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Lines of files and members read to their end.

    A fault without member concerns the whole archive. The lines are written to the
    shared folder first, so that files are decompressed once, for faults and lines
    together. Few bytes of faults are broadcast, more go through a salted join.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "lines")
    lines.write.option("compression", "zstd").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    keys = ["file", "member", *(["stream"] if "stream" in lines.columns else [])]
    faults = cut_lineage(lines.where(F.col("read_error").isNotNull()).select(*keys).distinct())
    good = lines.where(F.col("read_error").isNull()).drop("read_error")
    size = key_bytes(faults, keys)
    if size is None:
        return good
    whole = faults.where(F.col("member").isNull()).select("file").distinct()
    part = faults.where(F.col("member").isNotNull())
    if size <= broadcast_bytes:
        return anti_join(anti_join(good, F.broadcast(whole), ["file"]), F.broadcast(part), keys)
    sizes = cut_lineage(good.groupBy(*keys).agg(F.count("*").alias("lines")))
    by_file = sizes.groupBy("file").agg(F.sum("lines").alias("lines"))
    salt_on = ("position", "value")
    kept = salted_anti_join(good, whole, by_file, ["file"], salt_on=salt_on)
    return salted_anti_join(kept, part, sizes, keys, salt_on=salt_on)
