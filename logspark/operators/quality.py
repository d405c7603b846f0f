"""Per-file quality: gate, report and line counts.

Every operator starts with one hash aggregate per file. It combines on the map side,
so a file holding a third of all lines sends a handful of rows through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.patterns import java_regex
from logspark.operators.joins import BROADCAST_BYTES, anti_join, key_bytes, salted_anti_join
from logspark.schema import FIELDS, UNPARSED_KINDS
from logspark.session import cut_lineage

# Fixed value: a file with this many bad lines is dropped.
BAD_LINE_LIMIT = 100


def gate_counts(entries: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Usable and bad lines of every file, whether reading it failed, and how."""
    usable = F.col("kind") == "lager"
    error = F.col("read_error") if "read_error" in entries.columns else F.lit(None).cast("string")
    failed = F.col("read_error").isNotNull()
    # The largest of texts is found by sorting, so lines are counted first, by hashing alone;
    # what is left are some rows for each file.
    counted = entries.withColumn("read_error", error).groupBy(*keys, "read_error").agg(
        F.count_if(usable & ~failed).alias("usable_lines"), F.count_if(~usable & ~failed).alias("bad_lines")
    )
    return counted.groupBy(*keys).agg(
        F.sum("usable_lines").alias("usable_lines"),
        F.sum("bad_lines").alias("bad_lines"),
        F.max(failed).alias("failed"),
        F.max("read_error").alias("read_error"),
    )


def _spread_faults(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A fault of a whole archive (no member given) is a fault of all its members."""
    if "member" not in keys:
        return counts
    # Only archives that failed as a whole matter, so no archive's members meet in one task.
    broken = cut_lineage(
        counts.where(F.col("failed") & F.col("member").isNull())
        .groupBy(F.col("file").alias("archive"))
        .agg(F.max("read_error").alias("archive_error"))
    )
    size = key_bytes(broken, ["archive", "archive_error"])
    if size is None:
        return counts
    broken = F.broadcast(broken) if size <= BROADCAST_BYTES else broken
    joined = counts.join(broken, F.col("file") == F.col("archive"), "left")
    return joined.withColumns(
        {
            "failed": F.col("failed") | F.col("archive").isNotNull(),
            "read_error": F.coalesce("read_error", "archive_error"),
        }
    ).select(*counts.columns)


def file_counts(entries: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """:func:`gate_counts` kept in the shared folder, faults of archives on all members."""
    return _spread_faults(cut_lineage(gate_counts(entries, keys)), keys)


def with_verdict(counts: DataFrame, bad_line_limit: int = BAD_LINE_LIMIT) -> DataFrame:
    """Counts of every file with ``kept``: what went into the result and what did not, and why."""
    return counts.drop("failed").withColumn("kept", passes_gate(bad_line_limit, F.col("read_error").isNotNull()))


def passes_gate(bad_line_limit: int = BAD_LINE_LIMIT, failed: Column | None = None) -> Column:
    """Condition on :func:`gate_counts` for a file to be kept."""
    failed = F.col("failed") if failed is None else failed
    return (F.col("bad_lines") < bad_line_limit) & (F.col("usable_lines") > 0) & ~failed


def file_gate(
    entries: DataFrame,
    *,
    bad_line_limit: int = BAD_LINE_LIMIT,
    keys: tuple[str, ...] = ("file",),
    counts: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Usable entries of the files that pass the gate.

    A file goes as a whole if it has ``bad_line_limit`` bad lines, no usable line, or
    could not be read to its end. The counts are computed first and kept in the shared
    folder. If the keys of the dropped files are small in bytes they are broadcast and
    the lines are not shuffled at all; otherwise see :func:`salted_anti_join`.

    ``counts`` may be given when the caller has them already.
    """
    if entries.isStreaming:
        raise ValueError("the file gate needs whole files; it cannot run on a stream")
    if counts is None:
        counts = file_counts(entries, keys)
    dropped = counts.where(~passes_gate(bad_line_limit))
    # Dropped files matter only if usable lines of theirs would pass otherwise.
    dropped = dropped.where((F.col("usable_lines") > 0)).select(*keys)
    size = key_bytes(dropped, keys)
    usable = entries.where(F.col("kind") == "lager")
    if "read_error" in entries.columns:
        usable = usable.where(F.col("read_error").isNull()).drop("read_error")
    if size is None:
        return usable
    if size <= broadcast_bytes:
        return anti_join(usable, F.broadcast(dropped), keys)
    sizes = counts.select(*keys, (F.col("usable_lines") + F.col("bad_lines")).alias("lines"))
    # The position tells equal entries of one file apart.
    salt_on = [*FIELDS, *(c for c in ("position",) if c in usable.columns)]
    return salted_anti_join(usable, dropped, sizes, keys, salt_on=salt_on)


def file_report(entries: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Total, failed and valid lines of every file.

    Give it the entries of *all* lines, empty ones included: an empty line counts as
    failed. A line that is a bare JSON ``null`` counts as neither failed nor valid.
    """
    failed = F.col("kind").isin(*UNPARSED_KINDS) & ~F.coalesce(
        F.trim("raw", F.lit(" \t\r\n")) == "null", F.lit(False)
    )
    return entries.groupBy(*keys).agg(
        F.count("*").alias("total_lines"),
        F.count_if(failed).alias("error_lines"),
        F.count_if(F.col("kind") == "lager").alias("valid_lines"),
    )


def with_error_ratio(report: DataFrame) -> DataFrame:
    """Add the lines that did parse and the percentage that did not (2 decimals)."""
    return report.withColumns(
        {
            "parsed_lines": F.col("total_lines") - F.col("error_lines"),
            "error_percent": F.round(F.col("error_lines") * 100.0 / F.col("total_lines"), 2),
        }
    )


def mixed_files(report: DataFrame) -> DataFrame:
    """Files that have failed lines as well as valid ones."""
    return report.where((F.col("error_lines") > 0) & (F.col("valid_lines") > 0))


def sort_report(report: DataFrame, by: str = "file") -> DataFrame:
    """Sort by ``file`` or, ascending, by the ``ratio`` of failed lines."""
    if by == "file":
        return report.orderBy("file")
    if by == "ratio":
        return report.orderBy(F.col("error_lines") / F.col("total_lines"), "file")
    raise ValueError(f"sort a report by 'file' or 'ratio', not {by!r}")


def line_counts(lines: DataFrame, *keys: str, count_empty: bool = False) -> DataFrame:
    """Number of lines, by default without empty ones."""
    counted = F.lit(True) if count_empty else F.length("value") > 0
    return lines.groupBy(*keys).agg(F.count_if(counted).alias("lines"))


def matching_line_counts(lines: DataFrame, regex: str, *keys: str) -> DataFrame:
    """Number of non-empty lines matching a regular expression."""
    hit = (F.length("value") > 0) & F.col("value").rlike(java_regex(regex))
    return lines.groupBy(*keys).agg(F.count_if(hit).alias("lines"))
