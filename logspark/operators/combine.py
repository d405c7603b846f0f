"""Merge, compare, de-duplicate and order entries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import levels, timestamps
from logspark.schema import FIELDS, ORIGIN


def merge(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of several entry tables; a column missing in one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_entry(left: str, right: str) -> Column:
    """Equality of two entries given as struct columns (or aliased tables)."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in FIELDS],
    )


def with_derived(entries: DataFrame) -> DataFrame:
    """Add the columns that follow from the entry fields."""
    return entries.withColumns(
        {
            "timestamp": timestamps.to_timestamp(F.col("epoch_sec"), F.col("nanos")),
            "level_name": levels.level_name(F.col("log_level")),
        }
    )


def unique_fields(entries: DataFrame) -> DataFrame:
    """One row per distinct entry, entry fields only.

    A grouping without aggregates runs as a hash aggregate with a map-side step, so
    any number of copies of one entry reaches the shuffle as one row per task. Where
    a copy came from is not kept: carrying it along would need a sort aggregate.
    """
    return entries.select(*FIELDS).distinct()


def time_order(entries: DataFrame) -> list[Column]:
    """Sort keys: instant, then where the line stands, then a hash of the entry.

    The later keys make the order repeatable and let the range partitioning split an
    instant shared by many entries. Equal entries of one instant can be split as well,
    since their position differs from one input split to the next.
    """
    origin = [F.col(c).asc() for c in ORIGIN if c in entries.columns]
    return [F.col("epoch_sec").asc(), F.col("nanos").asc(), *origin, F.xxhash64(*FIELDS).asc()]


def sort_by_time(entries: DataFrame) -> DataFrame:
    """Global ascending order by time."""
    if entries.isStreaming:
        raise ValueError("a stream cannot be sorted: sorting needs all of the input")
    return entries.orderBy(*time_order(entries))


def unique_by_time(entries: DataFrame) -> DataFrame:
    """Distinct entries in time order."""
    return sort_by_time(with_derived(unique_fields(entries)))
