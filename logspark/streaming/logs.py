"""Structured Streaming: the same columns on unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logspark.operators.combine import sort_by_time
from logspark.operators.parse import usable_entries
from logspark.schema import FIELDS


def stream_entries(
    lines: DataFrame, *, where: Column | None = None, sort: bool = False, **parse_options
) -> DataFrame:
    """Usable entries of a line stream, optionally filtered; never sorted."""
    if not lines.isStreaming:
        raise ValueError("stream_entries needs a streaming DataFrame")
    if sort:
        raise ValueError("a stream cannot be sorted: sorting needs all of the input")
    entries = usable_entries(lines, **parse_options)
    return entries.where(where) if where is not None else entries


def stream_unique(entries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of an entry that arrive within ``delay`` of each other's time.

    State is kept only as long as the watermark needs it; a copy that comes later
    than that passes. Keys include the full nanosecond instant.
    """
    return entries.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(FIELDS))


def write_stream_sorted(
    entries: DataFrame, write_batch: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """Order each micro-batch by time before it is written (no order across batches)."""
    return entries.writeStream.foreachBatch(
        lambda batch, batch_id: write_batch(sort_by_time(batch), batch_id)
    )


def write_stream_text(entries: DataFrame, value: Column, path: str, checkpoint: str) -> DataStreamWriter:
    """Write a text rendering of each entry (JSON or readable) to files."""
    return (
        entries.select(F.col("*"), value.alias("value"))
        .select("value")
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
