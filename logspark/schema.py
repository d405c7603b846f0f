"""Column names of the entry table, shared by every module."""

from __future__ import annotations

# The eight fields that make two log entries equal, in output order. Time is the
# pair (epoch_sec, nanos).
FIELDS = (
    "epoch_sec",
    "nanos",
    "log_level",
    "source",
    "message",
    "session",
    "error",
    "trace",
    "data",
)

# Where a line came from: its file, the archive member inside it if any, and the
# position of the line (line number in an archive member, else split offset).
ORIGIN = ("file", "member", "stream", "position")

# Every column of a parsed line.
ENTRY_COLUMNS = (
    "epoch_sec",
    "nanos",
    "timestamp",
    "log_level",
    "level_name",
    "source",
    "message",
    "session",
    "error",
    "trace",
    "data",
    "kind",
    "raw",
)
KINDS = ("lager", "no_timestamp", "raw", "too_deep")
# Kinds without fields; their text is in ``raw``.
UNPARSED_KINDS = ("raw", "too_deep")
