"""Text columns: escape sequences, padding, indentation, component and log type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal escape sequences.
CSI_SEQUENCE = "\x1b\\[[0-?]*[ -/]*[@-~]"
ESC_SEQUENCE = "\x1b[@-_][0-?]*[ -/]*[@-~]"
RESET = "\x1b[0m"
RED = "\x1b[91m"
GRAY = "\x1b[90m"

# Display colour of each known component.
COMPONENT_COLORS = {
    "auctioneer": "\x1b[95m",
    "bbs": "\x1b[36m",
    "converger": "\x1b[94m",
    "executor": "\x1b[92m",
    "file-server": "\x1b[34m",
    "garden-linux": "\x1b[35m",
    "loggregator": "\x1b[33m",
    "nsync-listener": "\x1b[98m",
    "rep": "\x1b[93m",
    "route-emitter": "\x1b[96m",
    "router": "\x1b[32m",
    "tps": "\x1b[97m",
}

# Shapes of foreign log lines, the more precise one first.
LOG_TYPE_SHAPES = (
    ("nginx_error", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[\w+\] \d+#\d:"),
    (
        "nginx_access",
        r"^([-_.a-zA-Z0-9]*) - \[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}[+ 0-9]*\]",
    ),
    ("go_std", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \p{Print}+"),
)


def strip_color(text: Column) -> Column:
    """Remove control sequences (``ESC [ ...``); lines without ESC skip the regex."""
    return F.when(
        F.contains(text, F.lit("\x1b")), F.regexp_replace(text, CSI_SEQUENCE, "")
    ).otherwise(text)


def strip_ansi(text: Column) -> Column:
    """Remove every complete two-byte-introducer escape sequence, not only ``ESC [``."""
    return F.when(
        F.contains(text, F.lit("\x1b")), F.regexp_replace(text, ESC_SEQUENCE, "")
    ).otherwise(text)


def pad_right(text: Column, width: int) -> Column:
    """Pad with spaces to ``width`` characters; longer text is kept whole."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def indent_block(text: Column, width: int) -> Column:
    """Put ``width`` spaces before every line and end the block with a newline."""
    margin = " " * width
    return F.concat(
        F.lit(margin), F.replace(text, F.lit("\n"), F.lit("\n" + margin)), F.lit("\n")
    )


def component(source: Column) -> Column:
    """The part of a source before its first colon."""
    return F.substring_index(source, ":", 1)


def component_color(source: Column) -> Column:
    """Colour code of a source's component; unknown components get the reset code."""
    colors = F.create_map(*[F.lit(x) for item in COMPONENT_COLORS.items() for x in item])
    return F.coalesce(colors[component(source)], F.lit(RESET))


def log_type(line: Column) -> Column:
    """Kind of a line that is not a log entry, or ``unknown``."""
    (name, shape), *others = LOG_TYPE_SHAPES
    found = F.when(line.rlike(shape), F.lit(name))
    for name, shape in others:
        found = found.when(line.rlike(shape), F.lit(name))
    return found.otherwise(F.lit("unknown"))


def contains_ignore_case(text: Column, part: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.upper(text), F.lit(part.upper()))
