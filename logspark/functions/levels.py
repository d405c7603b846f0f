"""Log level columns: decode, merge and print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four levels in ascending order; the index is the number.
LEVEL_NAMES = ("debug", "info", "error", "fatal")
DEBUG, INFO, ERROR, FATAL = range(4)


def level_number(level: int | str) -> int:
    """Check a level argument given as number or name."""
    if isinstance(level, str):
        if level.lower() not in LEVEL_NAMES:
            raise ValueError(f"invalid log level: {level!r}")
        return LEVEL_NAMES.index(level.lower())
    if isinstance(level, bool) or level not in range(len(LEVEL_NAMES)):
        raise ValueError(f"invalid log level: {level!r}")
    return int(level)


def decode_level(text: Column) -> Column:
    """Level number of ``0``-``3`` or a lower-case level name, else NULL."""
    known = F.create_map(
        *[
            F.lit(item)
            for number, name in enumerate(LEVEL_NAMES)
            for item in (str(number), number, name, number)
        ]
    )
    return known[text]


def merge_levels(v1: Column, v2: Column) -> Column:
    """The higher of the two wire levels; a missing one counts as debug."""
    return F.greatest(F.coalesce(v1, F.lit(DEBUG)), F.coalesce(v2, F.lit(DEBUG)))


def level_name(level: Column) -> Column:
    """``debug`` ... ``fatal``; any other number gives ``invalid``."""
    names = F.array(*[F.lit(name) for name in LEVEL_NAMES])
    return F.when(level.isNotNull(), F.coalesce(F.get(names, level), F.lit("invalid")))


def level_label(level: Column) -> Column:
    """Upper-case level name."""
    return F.upper(level_name(level))
