"""Filters over entries and raw lines.

Every function returns a Column, so conditions combine with ``&`` and ``|`` and work
the same on batch and streaming DataFrames.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.levels import LEVEL_NAMES, level_number
from logspark.functions.patterns import matches_any
from logspark.functions.timestamps import TimeBound, bound_instant

# Text fields a pattern can be aimed at.
PATTERN_FIELDS = ("source", "message", "session", "error", "trace", "data")


def usable() -> Column:
    """Parsed entries that have a timestamp."""
    return F.col("kind") == "lager"


def time_range(
    start: TimeBound | None = None,
    end: TimeBound | None = None,
    closed: str = "both",
    now: dt.datetime | None = None,
) -> Column:
    """Entries between two instants, compared to the nanosecond.

    Durations and dates without a year refer to ``now``.

    ``closed="neither"`` leaves both ends out. A missing end is open; an entry
    without time never matches.
    """
    if closed not in ("both", "neither"):
        raise ValueError(f"closed must be 'both' or 'neither', not {closed!r}")
    low = None if start is None else bound_instant(start, now)
    high = None if end is None else bound_instant(end, now)
    if low and high and low > high:
        raise ValueError(f"time range starts at {start!r}, after its end {end!r}")
    sec, nanos = F.col("epoch_sec"), F.col("nanos")
    inclusive = closed == "both"
    inside = sec.isNotNull()
    # The plain comparison on seconds comes first: it can be pushed into a scan of
    # stored entries and skip row groups.
    if low:
        edge = nanos >= low[1] if inclusive else nanos > low[1]
        inside = inside & (sec >= low[0]) & ((sec > low[0]) | edge)
    if high:
        edge = nanos <= high[1] if inclusive else nanos < high[1]
        inside = inside & (sec <= high[0]) & ((sec < high[0]) | edge)
    return inside


def min_level(level: int | str) -> Column:
    """Entries at or above a level."""
    return F.col("log_level") >= level_number(level)


def level_in(levels: Iterable[int | str]) -> Column:
    """Entries at one of the given levels."""
    numbers = sorted({level_number(level) for level in levels})
    if not numbers:
        raise ValueError("no log levels given")
    return F.col("log_level").isin(*numbers)


def line_min_level(level: int | str, line: str = "value") -> Column:
    """Cheap test for a level on an unparsed line.

    A guess from the text: it misses legal spellings such as ``"level" : "info"``.
    Use it where that is acceptable; nothing here applies it on its own.
    """
    lowest = level_number(level)
    numbers = "".join(str(n) for n in range(lowest, len(LEVEL_NAMES)))
    names = "|".join(LEVEL_NAMES[lowest:])
    return F.col(line).rlike(rf'level":\s*(?:[{numbers}]|"(?:{names})")')


def field_matches(field: str, patterns: str | Iterable[str]) -> Column:
    """Entries whose field is not empty and matches any of the patterns."""
    if field not in PATTERN_FIELDS:
        raise ValueError(f"no text field {field!r}; expected one of {PATTERN_FIELDS}")
    value = F.col(field)
    return F.coalesce((value != "") & matches_any(value, patterns), F.lit(False))


def entry_filter(
    *,
    start: TimeBound | None = None,
    end: TimeBound | None = None,
    level: int | str | None = None,
    fields: Mapping[str, str | Iterable[str]] | None = None,
) -> Column:
    """Composite filter: time AND level AND (any field pattern hits).

    Parts left out do not restrict, and with no part at all everything passes.
    """
    parts = []
    if start is not None or end is not None:
        parts.append(time_range(start, end))
    if level is not None:
        parts.append(min_level(level))
    if fields:
        parts.append(reduce(lambda a, b: a | b, [field_matches(f, p) for f, p in fields.items()]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def line_filter(
    fields: Mapping[str, str | Iterable[str]] | None = None, line: str = "value"
) -> Column:
    """The field patterns of :func:`entry_filter` tried on the unparsed line.

    Not exact: text that JSON escapes looks different in the line. Opt-in only.
    """
    if not fields:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [matches_any(F.col(line), p) for p in fields.values()])
