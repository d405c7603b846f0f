"""Parse lines into the entry table."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import entry, levels, timestamps
from logspark.schema import ENTRY_COLUMNS, UNPARSED_KINDS


def parse_lines(
    lines: DataFrame,
    *,
    case_insensitive_keys: bool = False,
    keep_nonstring: bool = False,
) -> DataFrame:
    """Replace the ``value`` column of a line DataFrame by the entry columns.

    ``kind`` is ``lager`` for a usable entry, ``no_timestamp`` for a well-formed one
    without time, ``too_deep`` for one nested beyond
    :data:`logspark.functions.entry.NESTING_LIMIT`, which is not parsed, and ``raw`` for every
    other line. The text of the last two is kept in ``raw``.
    Works on batch and streaming input; no shuffle and no Python.
    """
    # A line that repeats a key keeps the last value. Stays on for the session, since the
    # lines are parsed when the result is used.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    origin = [c for c in lines.columns if c != "value"]
    # Each select is one step, so that a costly value is computed once and then
    # referred to by name.
    table = lines
    for keeps, columns in _steps(id(SparkContext._gateway), case_insensitive_keys, keep_nonstring):
        table = table.select(*origin, *keeps, *columns)
    return table.select(*origin, *ENTRY_COLUMNS)


Step = tuple[tuple[str, ...], list[Column]]


@lru_cache(maxsize=8)
def _steps(gateway: int, case_insensitive_keys: bool, keep_nonstring: bool) -> list[Step]:
    """For each step the columns that stay and the ones that are made.

    They are the same for every table, and making some hundred expressions takes longer
    than planning them. ``gateway`` is the connection they belong to.
    """
    deep = entry.deep_parts(F.col("value")).alias("deep")
    readable = F.col("deep.closed") & (F.col("deep.depth") <= entry.NESTING_LIMIT)
    sound = F.when(readable, entry.sound_pieces(F.col("deep.pieces"))).alias("sound")
    parsed = entry.parsed_line(F.col("value"), F.col("deep"), F.col("sound")).alias("line")
    wrapped = entry.wrapped_line(F.col("line"), case_insensitive_keys).alias("w")
    texts = _any_case_texts() if case_insensitive_keys else _texts()
    return [
        (("value",), [deep]),
        (("value", "deep"), [sound]),
        (("value",), [F.col("deep.pieces"), (F.col("deep.depth") > entry.NESTING_LIMIT).alias("over"), parsed]),
        ((*_LINE, "line"), [wrapped]),
        *texts,
        *_entry_steps(keep_nonstring),
    ]


# The line as it came, its deep values, and whether it is nested beyond the limit.
_LINE = ("value", "pieces", "over")
_KEYS = (*entry.SCALAR_KEYS, *entry.STRING_KEYS)
_TEXTS = ("whole", *[f"t_{key}" for key in (*_KEYS, "data")], *[f"no_{key}" for key in (*_KEYS, "data")])


def _entry_steps(keep_nonstring: bool) -> list[Step]:
    """From the texts of all fields to the entry columns."""
    text = F.col("t_timestamp")
    epoch = timestamps.epoch_seconds(text)
    typed = [
        epoch.alias("epoch"),
        F.when(epoch.isNull(), timestamps.rfc3339_instant(text)).alias("instant"),
        levels.decode_level(F.col("t_log_level")).alias("v1"),
        levels.decode_level(F.col("t_level")).alias("v2"),
    ]
    value_read = {
        "timestamp": F.col("epoch").isNotNull() | F.col("instant").isNotNull(),
        "log_level": F.col("v1").isNotNull(),
        "level": F.col("v2").isNotNull(),
        **{key: F.col(f"t_{key}").isNotNull() for key in (*entry.STRING_KEYS, "data")},
    }
    valid: Column = F.col("whole")
    for key, is_read in value_read.items():
        valid = valid & (F.col(f"no_{key}") | is_read)

    sec = F.coalesce(F.col("epoch"), F.unix_seconds("instant"))
    nanos = F.coalesce(
        timestamps.epoch_nanos(text, F.col("epoch")),
        timestamps.rfc3339_nanos(text, F.col("instant")),
    )
    kind = (
        F.when(
            ~F.coalesce(valid, F.lit(False)),
            F.when(F.col("over"), F.lit("too_deep")).otherwise(F.lit("raw")),
        )
        .when(timestamps.is_zero_time(sec, nanos), F.lit("no_timestamp"))
        .otherwise(F.lit("lager"))
    )
    # A generator of one row. Filters on its columns stay above it; without it they
    # would be pushed further down, where they would parse every line a second time.
    values = {
        "kind": kind,
        "sec": sec,
        "ns": nanos,
        "lvl": levels.merge_levels(F.col("v1"), F.col("v2")),
        **{f"t_{key}": F.col(f"t_{key}") for key in (*entry.STRING_KEYS, "data")},
    }
    tagged = F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()])))

    def parsed(value: Column) -> Column:
        return F.when(~F.col("kind").isin(*UNPARSED_KINDS), value)

    def timed(value: Column) -> Column:
        return F.when(F.col("kind") == "lager", value)

    members = F.col("t_data")
    opened = [
        *[entry.string_value(members[key]).alias(f"d_{key}") for key in entry.LIFTED_KEYS],
        entry.residual_members(members, keep_nonstring).alias("rest"),
    ]
    made = [
        timed(F.col("sec")).alias("epoch_sec"),
        timed(F.col("ns")).alias("nanos"),
        timed(timestamps.to_timestamp(F.col("sec"), F.col("ns"))).alias("timestamp"),
        parsed(F.col("lvl")).alias("log_level"),
        parsed(levels.level_name(F.col("lvl"))).alias("level_name"),
        *[
            parsed(F.coalesce(F.col(f"t_{key}"), F.lit(""))).alias(key)
            for key in ("source", "message")
        ],
        *[
            parsed(entry.first_text(F.col(f"t_{key}"), F.col(f"d_{key}"))).alias(key)
            for key in ("session", "error", "trace")
        ],
        parsed(entry.with_pieces(entry.compact_json(F.col("rest")), F.col("value"), F.col("pieces"))).alias("data"),
        F.when(F.col("kind").isin(*UNPARSED_KINDS), F.col("value")).alias("raw"),
    ]
    return [
        ((*_LINE, *_TEXTS), typed),
        (_LINE, [tagged]),
        ((*_LINE, *values), opened),
        (("kind",), made),
    ]


def _texts() -> list[Step]:
    """Text of every field, checked against a second parse where its type is unsure."""
    w = entry.wire_fields(F.col("w"))
    raw = [
        entry.whole_line(F.col("w")).alias("whole"),
        *[w[key].alias(f"w_{key}") for key in entry.WIRE_KEYS],
    ]
    doubt: Column = F.lit(False)
    for key in entry.UNSURE_KEYS:
        doubt = doubt | F.coalesce(entry.unsure(key, F.col(f"w_{key}")), F.lit(False))
    exact_fields = F.struct(*[v.alias(k) for k, v in entry.exact_fields(F.col("line")).items()])
    settled = F.when(doubt, exact_fields).alias("exact")

    def text(key: str) -> Column:
        plain = F.col(f"w_{key}")
        if key not in entry.UNSURE_KEYS:
            return plain
        exact = F.col("exact")
        return F.when(exact.isNull(), plain).otherwise(entry.strict_text(key, exact[key]))

    texts = [
        *[text(key).alias(f"t_{key}") for key in _KEYS],
        entry.object_members(F.col("w_data")).alias("t_data"),
        *[F.col(f"w_{key}").isNull().alias(f"no_{key}") for key in _KEYS],
        entry.is_absent(F.col("w_data")).alias("no_data"),
    ]
    fields = tuple(f"w_{key}" for key in entry.WIRE_KEYS)
    return [((*_LINE, "line"), raw), ((*_LINE, "line", "whole", *fields), [settled]), ((*_LINE, "whole"), texts)]


def _any_case_texts() -> list[Step]:
    """The same columns from fields that are VARIANT to begin with."""
    w = entry.any_case_fields(F.col("w"))
    texts = [
        entry.whole_line(F.col("w")).alias("whole"),
        *[entry.strict_text(key, w[key]).alias(f"t_{key}") for key in _KEYS],
        entry.object_members(w["data"]).alias("t_data"),
        *[entry.is_absent(w[key]).alias(f"no_{key}") for key in entry.WIRE_KEYS],
    ]
    return [(_LINE, texts)]


def usable_entries(lines: DataFrame, **options) -> DataFrame:
    """Parse and keep only entries with a timestamp."""
    parsed = parse_lines(lines, **options)
    return parsed.where(F.col("kind") == "lager").drop("kind", "raw")
