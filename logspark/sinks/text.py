"""Write entries as JSON lines or readable text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import levels, text, timestamps

# Column widths of the readable form.
SOURCE_WIDTH = 16
LEVEL_WIDTH = 7
SESSION_WIDTH = 10
BLOCK_INDENT = 27

# Characters that are escaped for safe embedding in HTML and scripts.
HTML_ESCAPES = (
    ("&", "\\u0026"),
    ("<", "\\u003c"),
    (">", "\\u003e"),
    ("\u2028", "\\u2028"),
    ("\u2029", "\\u2029"),
)


def _escape_html(json: Column) -> Column:
    """In JSON text these characters occur only inside strings, so this keeps values."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), HTML_ESCAPES, json)


def json_line(zone: str | None = None, escape_html: bool = True) -> Column:
    """One entry as a JSON object; empty session, error, trace and data are left out.

    The text of ``data`` is inserted as it is rather than parsed once more.
    """
    head = F.to_json(
        F.struct(
            timestamps.rfc3339_text(F.col("epoch_sec"), F.col("nanos"), zone).alias("timestamp"),
            levels.level_name(F.col("log_level")).alias("log_level"),
            "source",
            "message",
            *[F.nullif(F.col(f), F.lit("")).alias(f) for f in ("session", "error", "trace")],
        )
    )
    line = F.when(F.col("data").isNull(), head).otherwise(
        F.concat(
            F.substring(head, F.lit(1), F.length(head) - 1),
            F.lit(',"data":'),
            F.col("data"),
            F.lit("}"),
        )
    )
    return _escape_html(line) if escape_html else line


def pretty_text(color: bool = True, zone: str | None = None, escape_html: bool = True) -> Column:
    """One entry as readable text: a header line, then error, trace and data indented.

    The text ends with a newline, or in colour with a newline and a reset code when an
    error or trace comes last.
    """
    def paint(code: Column | str, value: Column) -> Column:
        if not color:
            return value
        return F.concat(F.lit(code) if isinstance(code, str) else code, value, F.lit(text.RESET))

    own = text.component_color(F.col("source"))
    level = F.col("log_level")
    level_color = (
        F.when(level == levels.DEBUG, F.lit(text.GRAY))
        .when(level.isin(levels.ERROR, levels.FATAL), F.lit(text.RED))
        .otherwise(own)
    )
    label = F.concat(F.lit("["), levels.level_label(level), F.lit("]"))
    session = F.coalesce("session", F.lit(""))
    header = F.concat(
        paint(own, text.pad_right(F.col("source"), SOURCE_WIDTH)),
        F.lit(" "),
        paint(level_color, text.pad_right(label, LEVEL_WIDTH)),
        F.lit(" "),
        paint(own, timestamps.display_time(F.col("epoch_sec"), F.col("nanos"), zone)),
        F.lit(" "),
        paint(text.GRAY, text.pad_right(session, SESSION_WIDTH)),
        F.lit(" "),
        paint(own, F.col("message")),
        F.lit("\n"),
    )

    def block(value: Column, code: str | None = None) -> Column:
        body = text.indent_block(value, BLOCK_INDENT)
        body = paint(code, body) if code else body
        return F.when(value.isNotNull() & (value != ""), body).otherwise(F.lit(""))

    data = _escape_html(F.col("data")) if escape_html else F.col("data")
    return F.concat(
        header, block(F.col("error"), text.RED), block(F.col("trace"), text.RED), block(data)
    )


def _write(df: DataFrame, value: Column, path: str, mode: str, compression: str | None) -> None:
    writer = df.select(value.alias("value")).write.mode(mode)
    writer = writer.option("compression", compression) if compression else writer
    writer.text(path)


def write_json_lines(
    entries: DataFrame,
    path: str,
    *,
    zone: str | None = None,
    escape_html: bool = True,
    mode: str = "errorifexists",
    compression: str | None = None,
) -> None:
    """Write entries as JSON lines; the order of a sorted table is kept across files."""
    _write(entries, json_line(zone, escape_html), path, mode, compression)


def write_pretty(
    entries: DataFrame,
    path: str,
    *,
    color: bool = True,
    zone: str | None = None,
    escape_html: bool = True,
    mode: str = "errorifexists",
    compression: str | None = None,
) -> None:
    """Write entries as readable text.

    The text sink ends every record with a newline of its own, so the last one of the
    text is taken off; a reset code after it moves in front.
    """
    record = pretty_text(color, zone, escape_html)
    trimmed = F.regexp_replace(record, "\n(\x1b\\[0m)?\\z", "$1")
    _write(entries, trimmed, path, mode, compression)


def write_stripped(
    lines: DataFrame, path: str, *, mode: str = "errorifexists", compression: str | None = None
) -> None:
    """Write lines with their escape sequences removed."""
    _write(lines, text.strip_color(F.col("value")), path, mode, compression)


def write_report(
    report: DataFrame, path: str, *, format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write a per-file report as ``parquet`` or ``csv``."""
    writer = report.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", "true")
    elif format != "parquet":
        raise ValueError(f"unknown report format {format!r}")
    writer.format(format).save(path)
