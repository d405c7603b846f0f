"""The whole job: read many logs, keep the good files, merge, sort and write."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.text import strip_color
from logspark.operators import combine, quality
from logspark.operators.parse import parse_lines
from logspark.schema import ENTRY_COLUMNS
from logspark.session import delete_path, scratch_path, spread
from logspark.sources import archives
from logspark.sources.files import locate
from logspark.sources.lines import (
    ARCHIVE_GLOBS,
    GZIP_GLOBS,
    STREAM_GLOBS,
    FileSelection,
    _as_list,
    read_lines,
)

# One reading of one file or member. Names repeat: a root can be given twice, and an
# archive can hold several members of one name; each is judged by itself.
FILE_KEYS = ("file", "member", "stream")
# Columns that follow from others; staged tables do without.
_DERIVED = ("timestamp", "level_name")


@dataclass
class StagedTables:
    """Tables written to the shared folder for one job; remove them when it is done."""

    paths: list[str] = field(default_factory=list)
    spark: SparkSession | None = None

    def write(self, df: DataFrame, name: str) -> DataFrame:
        spark = self.spark = df.sparkSession
        path = scratch_path(spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the tables; what was made from them cannot be used any more."""
        while self.paths:
            delete_path(self.spark, self.paths.pop())


@dataclass
class Combined:
    """Entries and, where files are gated, what became of every file.

    ``files`` has ``file, member, stream, usable_lines, bad_lines, read_error, kept``.
    ``release()`` removes the tables behind both, once they have been used.
    """

    entries: DataFrame
    files: DataFrame | None
    tables: StagedTables

    def release(self) -> None:
        self.tables.release()


def _columns(lines: DataFrame) -> DataFrame:
    """Bring the native and the streamed reader to the same columns."""
    missing = {"member": "string", "stream": "string", "read_error": "string"}
    added = {c: F.lit(None).cast(t) for c, t in missing.items() if c not in lines.columns}
    return lines.withColumns(added).select("file", "member", "stream", "position", "value", "read_error")


def _is_one_file(path: str) -> bool:
    """True for a plain file; wildcards and directories are not one."""
    if any(c in path for c in "*?[{"):
        return False
    system, inner = locate(path)
    return system.get_file_info(inner).type == fs.FileType.File


def read_tree(
    spark: SparkSession,
    paths: str | Iterable[str],
    *,
    selection: FileSelection | None = None,
    on_error: str = "drop_file",
    on_archive_error: str = "fail",
    strip: bool = False,
) -> DataFrame:
    """Lines of whole trees, archives included.

    Columns ``file, member, stream, position, value, read_error``.

    ``on_error`` says what a damaged gzip file does: ``drop_file`` marks it so that the
    gate removes it whole, ``fail`` fails the query, ``keep_prefix`` reads up to the
    fault. The last two use Spark's own, faster gzip reader.
    """
    if on_error not in ("drop_file", "fail", "keep_prefix"):
        raise ValueError(f"unknown on_error: {on_error!r}")
    roots, chosen = _as_list(paths), selection or FileSelection()
    own_gzip = on_error == "drop_file"
    native = read_lines(
        spark,
        roots,
        selection=chosen,
        skip=[*ARCHIVE_GLOBS, *STREAM_GLOBS, *(GZIP_GLOBS if own_gzip else ())],
        keep_truncated=on_error == "keep_prefix",
    )
    streamed = archives.read_streamed(
        spark,
        roots,
        selection=chosen,
        gzip_files=own_gzip,
        on_archive_error=on_archive_error,
    )
    hidden = archives.read_underscored(
        spark,
        roots,
        selection=chosen,
        on_archive_error=on_archive_error,
        on_file_error="fail" if on_error == "fail" else "drop",
    )
    if hidden is not None and on_error == "keep_prefix":
        hidden = hidden.where(F.col("read_error").isNull())
    tables = [native, streamed, *([] if hidden is None else [hidden])]
    lines = combine.merge([_columns(table) for table in tables])
    if strip:
        lines = lines.withColumn("value", strip_color(F.col("value")))
    return lines


def read_one_file(
    spark: SparkSession, path: str, *, on_error: str = "fail", strip: bool = False
) -> DataFrame:
    """Lines of one file, whatever its name.

    A fault in it fails the query; with ``on_error="keep_prefix"`` the lines before it stay.
    """
    name, keep = path.rpartition("/")[2], on_error == "keep_prefix"
    if any(archives.glob_matches(name, g) for g in (*ARCHIVE_GLOBS, *STREAM_GLOBS)):
        how = "drop" if keep else "fail"
        lines = archives.read_streamed(spark, path, on_archive_error=how, on_file_error=how)
        lines = _columns(lines).where(F.col("read_error").isNull())
    else:
        lines = _columns(read_lines(spark, path, keep_truncated=keep))
        if name.endswith(".gz"):  # read by one task
            lines = spread(lines)
    return lines.withColumn("value", strip_color(F.col("value"))) if strip else lines


def staged(
    lines: DataFrame,
    *,
    where: Column | None = None,
    tables: StagedTables | None = None,
    **parse_options,
) -> DataFrame:
    """Parsed lines as a Parquet table in the shared folder.

    Gate counts, sort sampling and output each go over the parsed lines. With the
    table they cost a column-pruned, compressed read instead of another decompression
    and parse, and a lost executor costs no more than that either. Every line is there
    with its file and ``kind``, but the fields only of usable entries that ``where`` lets
    through (``wanted``); derived columns and raw text are not kept. ``tables`` remembers
    the table for its removal.
    """
    parsed = parse_lines(lines, **parse_options)
    wanted = F.col("kind") == "lager"
    if where is not None:
        wanted = wanted & F.coalesce(where, F.lit(False))
    fields = [c for c in ENTRY_COLUMNS if c not in (*_DERIVED, "kind", "raw")]
    origin = [c for c in parsed.columns if c not in ENTRY_COLUMNS]
    # A one-row generator, so that the condition does not parse every line again.
    marked = parsed.select("*", F.explode(F.array(wanted)).alias("wanted"))
    narrow = marked.select(
        *[c for c in origin if c != "position"],
        *[F.when(F.col("wanted"), F.col(c)).alias(c) for c in origin if c == "position"],
        *[F.when(F.col("wanted"), F.col(c)).alias(c) for c in fields],
        "kind",
        "wanted",
    )
    return (tables or StagedTables()).write(narrow, "staged")


def entries_of(
    lines: DataFrame,
    *,
    gate: bool,
    bad_line_limit: int = quality.BAD_LINE_LIMIT,
    where: Column | None = None,
    unique: bool = False,
    sort: bool = True,
    stage: bool = True,
    **parse_options,
) -> DataFrame:
    """Parse, gate, filter, de-duplicate and sort; see :func:`combined_entries`."""
    return combined_entries(
        lines,
        gate=gate,
        bad_line_limit=bad_line_limit,
        where=where,
        unique=unique,
        sort=sort,
        stage=stage,
        **parse_options,
    ).entries


def combined_entries(
    lines: DataFrame,
    *,
    gate: bool,
    bad_line_limit: int = quality.BAD_LINE_LIMIT,
    where: Column | None = None,
    unique: bool = False,
    sort: bool = True,
    stage: bool = True,
    **parse_options,
) -> Combined:
    """Parse, gate, filter, de-duplicate and sort.

    The gate sees all lines of a file; ``where`` restricts what comes after it.
    ``unique`` implies sorting. ``stage`` parses once into a table where the lines
    would be gone over several times otherwise; see :func:`staged`.
    """
    tables, files = StagedTables(), None
    if stage and (gate or (sort and not unique)):
        parsed = staged(lines, where=where, tables=tables, **parse_options)
    else:
        parsed = parse_lines(lines, **parse_options).drop("raw", *_DERIVED)
        passed = F.lit(True)
        if where is not None:  # may name derived columns
            parsed = combine.with_derived(parsed)
            passed = F.coalesce(where, F.lit(False))
        parsed = parsed.withColumn("wanted", passed).drop(*_DERIVED)
    if gate:
        keys = tuple(k for k in FILE_KEYS if k in parsed.columns)
        counts = quality.file_counts(parsed, keys)
        files = quality.with_verdict(counts, bad_line_limit)
        entries = quality.file_gate(
            parsed, bad_line_limit=bad_line_limit, keys=keys, counts=counts
        )
    else:
        entries = parsed.where(F.col("kind") == "lager").drop("read_error")
    entries = combine.with_derived(entries.where("wanted").drop("kind", "wanted"))
    entries = entries.select(
        *[c for c in entries.columns if c not in ENTRY_COLUMNS],
        *[c for c in ENTRY_COLUMNS if c in entries.columns],
    )
    if unique:
        entries = combine.unique_by_time(entries)
    elif sort:
        entries = combine.sort_by_time(entries)
    return Combined(entries, files, tables)


def combine_job(
    spark: SparkSession,
    paths: str | Iterable[str],
    *,
    selection: FileSelection | None = None,
    where: Column | None = None,
    unique: bool = False,
    sort: bool = True,
    bad_line_limit: int = quality.BAD_LINE_LIMIT,
    on_error: str = "drop_file",
    on_archive_error: str = "fail",
    strip: bool = False,
    stage: bool = True,
    **parse_options,
) -> Combined:
    """One time-ordered entry table from files, trees and archives, with what was left out.

    A single file that is not a tar is read whatever its name and is not gated. In any
    other case names are filtered, archives are opened and files of poor quality go.
    """
    roots = _as_list(paths)
    single = len(roots) == 1 and not roots[0].endswith((".tar", ".tgz", ".tar.gz"))
    if single and selection is None and _is_one_file(roots[0]):
        lines, gate = read_one_file(spark, roots[0], on_error=on_error, strip=strip), False
    else:
        lines = read_tree(
            spark,
            roots,
            selection=selection,
            on_error=on_error,
            on_archive_error=on_archive_error,
            strip=strip,
        )
        gate = True
    return combined_entries(
        lines,
        gate=gate,
        bad_line_limit=bad_line_limit,
        where=where,
        unique=unique,
        sort=sort,
        stage=stage,
        **parse_options,
    )


def combine_logs(spark: SparkSession, paths: str | Iterable[str], **options) -> DataFrame:
    """The entries of :func:`combine_job` alone, which takes the same options."""
    return combine_job(spark, paths, **options).entries


def quality_report(
    spark: SparkSession, paths: str | Iterable[str], *, only_mixed: bool = True
) -> DataFrame:
    """Per-file report over all ``*.log`` files below the paths, best file first."""
    lines = read_lines(
        spark, paths, selection=FileSelection(include=("*.log",)), keep_empty=True
    )
    report = quality.file_report(parse_lines(lines))
    if only_mixed:
        report = quality.mixed_files(report)
    return quality.sort_report(quality.with_error_ratio(report), by="ratio")


__all__ = [
    "Combined",
    "StagedTables",
    "combine_job",
    "combine_logs",
    "combined_entries",
    "entries_of",
    "quality_report",
    "read_one_file",
    "read_tree",
    "staged",
]
assert set(FILE_KEYS).isdisjoint(ENTRY_COLUMNS)
