"""Native line source: plain, gzip and bzip2 files read by Spark's text source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.patterns import glob_matches_any, glob_regex
from logspark.functions.text import strip_color
from logspark.session import listing_in_few_tasks

# Names taken for logs when nothing else is asked for.
DEFAULT_GLOBS = ("*.log", "*.log.*.gz")

# Names of archives, and of compressed files Spark cannot open itself.
ARCHIVE_GLOBS = ("*.tar", "*.tgz", "*.tar.gz")
STREAM_GLOBS = ("*.xz", "*.bz", "*.tbz", "*.tbz2")
GZIP_GLOBS = ("*.gz",)


@dataclass(frozen=True)
class FileSelection:
    """Which files of a directory tree are read, by shell globs on base names.

    Without ``all_files`` and ``include`` only the default log names are read. An empty
    ``include`` lets every name through, an empty ``exclude`` stops none.
    """

    include: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)
    exclude_dir: Sequence[str] = field(default_factory=tuple)
    all_files: bool = False

    def __post_init__(self) -> None:
        for name in ("include", "exclude", "exclude_dir"):
            globs = tuple(getattr(self, name))
            for glob in globs:
                glob_regex(glob)
            object.__setattr__(self, name, globs)

    @property
    def wanted(self) -> tuple[str, ...]:
        if self.include:
            return tuple(self.include)
        return () if self.all_files else DEFAULT_GLOBS

    def name_filter(self, name: Column) -> Column:
        """Condition on a base name."""
        keep = glob_matches_any(name, self.wanted) if self.wanted else F.lit(True)
        return keep & ~glob_matches_any(name, self.exclude)

    def directory_filter(self, path: Column, roots: Iterable[str]) -> Column:
        """Condition on a file's path: no directory below the root is excluded."""
        if not self.exclude_dir:
            return F.lit(True)
        below = _path_below(path, roots)
        parents = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
        return ~F.exists(parents, lambda d: glob_matches_any(d, self.exclude_dir))


def _without_scheme(path: str) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def _path_below(path: Column, roots: Iterable[str]) -> Column:
    """The part of a path after its root; the whole path for roots with wildcards."""
    plain = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    cut = [
        F.when(F.startswith(plain, F.lit(root + "/")), F.substring(plain, len(root) + 2, 2**31 - 1))
        for root in sorted(map(_without_scheme, roots), key=len, reverse=True)
    ]
    return F.coalesce(*cut, plain)


def disjoint_groups(roots: Iterable[str]) -> list[list[str]]:
    """Split roots so that none contains another of its group.

    One file listing names each file once, but a file given twice is to be read twice.
    """
    groups: list[list[str]] = []
    for root in roots:
        here = _without_scheme(root) + "/"
        for group in groups:
            others = [_without_scheme(r) + "/" for r in group]
            if not any(here.startswith(o) or o.startswith(here) for o in others):
                group.append(root)
                break
        else:
            groups.append([root])
    return groups


def union_of_groups(read: Callable[[list[str]], DataFrame], roots: Iterable[str]) -> DataFrame:
    """One table of all groups; ``stream`` begins with the number of the group.

    A file reached through two roots is read twice, and each reading stands for itself.
    """
    tables = []
    for number, group in enumerate(disjoint_groups(roots)):
        table = read(group)
        inner = F.coalesce("stream", F.lit("")) if "stream" in table.columns else F.lit("")
        tables.append(table.withColumn("stream", F.concat(F.lit(f"{number}:"), inner)))
    return reduce(DataFrame.unionByName, tables)


def _decoded(column: str) -> Column:
    """A name from the file metadata, which comes percent-encoded."""
    name = F.col(column)
    # Asked of every line, and most names have nothing to decode.
    return F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def _as_list(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    *,
    selection: FileSelection | None = None,
    skip: Iterable[str] = (),
    keep_empty: bool = False,
    strip: bool = False,
    keep_truncated: bool = False,
) -> DataFrame:
    """Lines of files and directory trees as ``file, position, value, stream``.

    ``stream`` tells the readings of a file that is reached through several roots apart.

    Lines end at ``\\n`` only, so a carriage return stays in the text. Directories are
    read recursively; names starting with ``.`` or ``_`` are passed over. Gzip and
    bzip2 files are decompressed by their suffix. ``selection`` filters by name, and
    ``skip`` leaves out names another reader takes. The filters act on file metadata,
    so other files are not opened.

    ``keep_empty`` keeps empty lines; ``strip`` removes escape sequences first.
    ``keep_truncated`` reads a broken compressed file up to its fault, instead of
    failing.
    """
    reader = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", str(keep_truncated).lower())
    )
    name, path = _decoded("_metadata.file_name"), _decoded("_metadata.file_path")
    skip = list(skip)

    def read(roots: list[str]) -> DataFrame:
        with listing_in_few_tasks(spark):
            lines = reader.text(roots)
        if selection:
            lines = lines.where(selection.name_filter(name))
            if selection.exclude_dir:
                lines = lines.where(selection.directory_filter(path, roots))
        if skip:
            lines = lines.where(~glob_matches_any(name, skip))
        value = strip_color(F.col("value")) if strip else F.col("value")
        return lines.select(
            path.alias("file"),
            F.col("_metadata.file_block_start").alias("position"),
            value.alias("value"),
        )

    lines = union_of_groups(read, _as_list(paths))
    return lines if keep_empty else lines.where(F.length("value") > 0)


def stream_lines(
    spark: SparkSession,
    path: str,
    *,
    glob: str | None = None,
    max_files_per_trigger: int | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Unbounded lines of the files that appear below a directory, as ``file, value``."""
    reader = (
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(path).select(_decoded("_metadata.file_path").alias("file"), "value")
    return lines if keep_empty else lines.where(F.length("value") > 0)
