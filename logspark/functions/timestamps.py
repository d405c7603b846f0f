"""Time columns with nanosecond precision.

Spark's TIMESTAMP stops at microseconds, so an instant is carried as two plain
columns, ``epoch_sec BIGINT`` and ``nanos INT``. Every expression here works on
those two and none depends on the session time zone.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes of the two time formats.
EPOCH_SHAPE = r"^(?:[1-9][0-9]{1,9}|[1-9][0-9]*\.[0-9]{1,9})\z"
RFC3339_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"
    r"(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
)
# Year 1 and the last second of year 9999: the range RFC 3339 can print.
FIRST_SECOND = -62135596800
LAST_SECOND = 253402300799


def epoch_seconds(text: Column) -> Column:
    """Whole seconds of an epoch text such as ``1520983802.429046154``.

    NULL unless the text is 2-10 digits, or digits with a 1-9 digit fraction.
    """
    seconds = F.substring_index(text, ".", 1).try_cast("bigint")
    return F.when(text.rlike(EPOCH_SHAPE), seconds)


def epoch_nanos(text: Column, seconds: Column) -> Column:
    """Nanoseconds of an epoch text whose seconds are already known."""
    fraction = F.rpad(F.substring_index(text, ".", -1), 9, "0").try_cast("int")
    return F.when(
        seconds.isNotNull(), F.when(F.contains(text, F.lit(".")), fraction).otherwise(F.lit(0))
    )


def rfc3339_instant(text: Column) -> Column:
    """TIMESTAMP of an RFC 3339 text, NULL if it is not a valid one."""
    return F.when(text.rlike(RFC3339_SHAPE), text.try_cast("timestamp"))


def rfc3339_nanos(text: Column, instant: Column) -> Column:
    """Nanoseconds of an RFC 3339 text; digits after the ninth are cut."""
    fraction = F.regexp_extract(text, r"\.([0-9]{1,9})", 1)
    return F.when(instant.isNotNull(), F.rpad(fraction, 9, "0").try_cast("int"))


def is_zero_time(sec: Column, nanos: Column) -> Column:
    """True for a missing time and for the first instant of year 1, which stands for one."""
    return sec.isNull() | ((sec == FIRST_SECOND) & (nanos == 0))


def to_timestamp(sec: Column, nanos: Column) -> Column:
    """TIMESTAMP truncated to microseconds; NULL beyond its range."""
    micros = F.try_add(
        F.try_multiply(sec, F.lit(1_000_000).cast("bigint")),
        F.floor(nanos / F.lit(1000)).cast("bigint"),
    )
    return F.timestamp_micros(micros)


def _wall_clock(sec: Column, zone: str | None) -> Column:
    """TIMESTAMP_NTZ of the second, read on a clock in ``zone`` (default UTC)."""
    in_range = F.when(sec.between(FIRST_SECOND, LAST_SECOND), sec)
    utc = F.timestamp_add("SECOND", in_range, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) if zone else utc


def display_time(sec: Column, nanos: Column, zone: str | None = None) -> Column:
    """``MM/DD HH:MM:SS.cc`` with truncated hundredths."""
    clock = _wall_clock(sec, zone).cast("string")
    return F.concat(
        F.substring(clock, 6, 2),
        F.lit("/"),
        F.substring(clock, 9, 2),
        F.lit(" "),
        F.substring(clock, 12, 8),
        F.lit("."),
        F.substring(F.lpad(nanos.cast("string"), 9, "0"), 1, 2),
    )


def rfc3339_text(sec: Column, nanos: Column, zone: str | None = None) -> Column:
    """RFC 3339 text with trailing zeros of the fraction removed."""
    local = _wall_clock(sec, zone)
    clock = F.translate(F.substring(local.cast("string"), 1, 19), " ", "T")
    fraction = F.when(
        nanos > 0,
        F.rtrim(F.concat(F.lit("."), F.lpad(nanos.cast("string"), 9, "0")), F.lit("0")),
    ).otherwise(F.lit(""))
    if not zone:
        return F.concat(clock, fraction, F.lit("Z"))
    minutes = F.timestamp_diff("MINUTE", _wall_clock(sec, None), local)
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"),
    )
    return F.concat(clock, fraction, F.when(minutes == 0, F.lit("Z")).otherwise(offset))


TimeBound = dt.datetime | dt.timedelta | int | float | Decimal | str


def bound_instant(bound: TimeBound, now: dt.datetime | None = None) -> tuple[int, int]:
    """``(epoch_sec, nanos)`` of a time argument.

    Accepts an aware datetime (a naive one is taken as UTC), a timedelta relative
    to now, an epoch number, an epoch or RFC 3339 text, or ``MM/DD HH:MM:SS[.cc]``
    (read in the current year, UTC). Pass an epoch with nanoseconds as text or
    Decimal, since a float cannot hold one.
    """
    utc = dt.timezone.utc
    now = now or dt.datetime.now(utc)
    if isinstance(bound, dt.timedelta):
        bound = now + bound
    if isinstance(bound, dt.datetime):
        aware = bound if bound.tzinfo else bound.replace(tzinfo=utc)
        since = aware - dt.datetime(1970, 1, 1, tzinfo=utc)
        return since.days * 86400 + since.seconds, since.microseconds * 1000
    if isinstance(bound, bool):
        raise ValueError(f"invalid time: {bound!r}")
    if isinstance(bound, (int, float, Decimal)):
        number = Decimal(str(bound))
        sec = int(number // 1)
        if number < sec:
            sec -= 1
        return sec, int((number - sec) * 1_000_000_000)
    text = bound.strip()
    if re.fullmatch(r"[0-9]+(\.[0-9]*)?", text):
        return bound_instant(Decimal(text))
    short = re.fullmatch(r"([0-9]{2})/([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{0,2}))?", text)
    if short:
        month, day, hour, minute, second = (int(g) for g in short.groups()[:5])
        hundredths = int((short.group(6) or "").ljust(2, "0"))
        when = dt.datetime(now.year, month, day, hour, minute, second, hundredths * 10_000, utc)
        return bound_instant(when)
    full = re.fullmatch(r"(.{19})(?:\.([0-9]{1,9}))?(Z|[+-][0-9]{2}:[0-9]{2})", text)
    if not full:
        raise ValueError(f"invalid time: {bound!r}")
    sec, _ = bound_instant(dt.datetime.fromisoformat(full.group(1) + full.group(3)))
    return sec, int((full.group(2) or "").ljust(9, "0"))
