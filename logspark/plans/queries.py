"""Registered queries: every operator run over the given tables.

Each function takes the session and a table folder. Outputs hold integers, text and
booleans only, so they compare exactly with the SQL in :mod:`logspark.plans.oracles`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import entry, levels, text, timestamps
from logspark.functions.patterns import glob_matches_any, matches, matches_any
from logspark.operators import combine, filters, quality
from logspark.operators.parse import parse_lines, usable_entries
from logspark.plans.combine import combine_job, combine_logs, entries_of, read_tree
from logspark.plans.sample_files import write_files, write_unit_files
from logspark.plans.sample_lines import (
    COLOR_OFF,
    COLOR_ON,
    event_parts,
    events,
    log_lines,
    sample_lines,
)
from logspark.schema import FIELDS
from logspark.session import scratch_path, spread_table
from logspark.sinks import text as sinks
from logspark.sources import archives
from logspark.sources.lines import FileSelection, read_lines, stream_lines
from logspark.streaming import logs as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Bounds the time queries use; the table covers January 2024.
RANGE_START = "2024-01-10T00:00:00Z"
RANGE_END = "2024-01-20T12:30:00.000000001Z"

# Component names the colour query cycles through: the known ones and one unknown.
COMPONENTS = (*text.COMPONENT_COLORS, "other")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def entries(spark: SparkSession, sf_dir: str, file: str = "node") -> DataFrame:
    return usable_entries(sample_lines(spark, sf_dir, file))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, empty ones included."""
    docs = spread_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("value"))


# --- parsing ---------------------------------------------------------------------


@query
def entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: usable entries per source and level."""
    return (
        entries(spark, sf_dir).groupBy("source", "level_name").agg(F.count("*").alias("entries"))
    )


@query
def parse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(sample_lines(spark, sf_dir))
    return parsed.withColumn("unix_us", F.unix_micros("timestamp")).drop("timestamp")


# Forms of a line that the sample lines do not have, by event number; `~` stands for the
# time and source that all but one begin with.
LINE_FORMS = (
    '{~,"log_level":9}',
    '{~,"level":"loud"}',
    '{~,"data":[1,2]}',
    '{~,"session":5}',
    '{~,"data":{"session":7,"n":1}}',
    '{"timestamp":SEC.5,"source":"s","message":"bare"}',
    '{"timestamp":"SEC.1234567890","source":"s"}',
    '{~,"message":"first","message":"last"}',
    '{~,"message":"tab\\t quote\\" \\u00e9"}',
    '{~,"message":"zürich 日本","data":{"ключ":"значение"}}',
    '{~,"message":"carriage return"}\r',
    '{~,"message":null,"data":null}',
    '{~,"data":{"n":' + "[" * 1200 + "]" * 1200 + "}}",
)


@query
def line_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong levels, odd data, bare times, repeated keys, escapes and other scripts."""
    form = F.element_at(F.array(*map(F.lit, LINE_FORMS)), (F.col("event_id") % len(LINE_FORMS)).cast("int") + 1)
    second = F.col("sec").cast("string")
    stamp = F.concat(F.lit('"timestamp":"'), second, F.lit('.25","source":"s"'))
    lines = event_parts(events(spark, sf_dir)).select(
        "event_id", F.replace(F.replace(form, F.lit("~"), stamp), F.lit("SEC"), second).alias("value")
    )
    return parse_lines(lines).select("event_id", "kind", *FIELDS)


# Depths of nested arrays, by event number; the entry and its data are two levels more.
DEPTHS = (3, 498, 499, 1200, 5000, 9998, 11000)


@query
def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting on both sides of the limits, in arrays and objects; brackets in strings do not count."""
    event = F.col("event_id")
    deep = F.element_at(F.array(*map(F.lit, DEPTHS)), ((event / 20).cast("long") % len(DEPTHS)).cast("int") + 1)
    depth = F.when(event % 20 == 0, deep).otherwise(event.cast("int") % 4)
    objects = F.concat(F.repeat(F.lit('{"a":'), depth), F.lit("1"), F.repeat(F.lit("}"), depth))
    arrays = F.concat(F.repeat(F.lit("["), depth), F.repeat(F.lit("]"), depth))
    nested = F.when(depth == 0, F.lit("0")).when(event % 3 == 0, objects).otherwise(arrays)
    quoted = F.concat(F.lit('"\\"'), F.repeat(F.lit("[{"), F.when(event % 20 == 1, 3000).otherwise(1)), F.lit('"'))
    stamp = F.concat(F.lit('{"timestamp":"'), F.col("sec").cast("string"), F.lit('.5","source":"s","message":'))
    value = F.concat(stamp, quoted, F.lit(',"data":{"n":'), nested, F.lit("}}"))
    parsed = parse_lines(event_parts(events(spark, sf_dir)).select("event_id", value.alias("value")))
    return parsed.select(
        "event_id", "kind", F.length("message").alias("message_length"), F.length("data").alias("data_length"),
        F.length("raw").alias("raw_length"),
    )


@query
def parse_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(sample_lines(spark, sf_dir))
    return parsed.groupBy("file", "kind").agg(F.count("*").alias("lines"))


@query
def strict_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("file", *FIELDS)


@query
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(sample_lines(spark, sf_dir))
    return parsed.where(F.col("kind") == "raw").select("file", "raw")


@query
def json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample_lines(spark, sf_dir)
    return lines.groupBy("file").agg(
        F.count_if(entry.may_be_json(F.col("value"))).alias("candidates"),
        F.count("*").alias("lines"),
    )


@query
def any_case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in another case, read by the case-insensitive option."""
    lines = sample_lines(spark, sf_dir)
    for key in ("source", "timestamp", "level"):
        lines = lines.withColumn(
            "value", F.replace("value", F.lit(f'"{key}":'), F.lit(f'"{key.title()}":'))
        )
    return usable_entries(lines, case_insensitive_keys=True).select("file", *FIELDS)


def _object_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose ``data.error`` is an object instead of a string."""
    return sample_lines(spark, sf_dir).withColumn(
        "value", F.replace("value", F.lit('"error":"boom"'), F.lit('"error":{"code":7}'))
    )


@query
def object_error_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_entries(_object_errors(spark, sf_dir)).select("file", "source", "error", "data")


@query
def object_error_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = usable_entries(_object_errors(spark, sf_dir), keep_nonstring=True)
    return kept.select("file", "source", "error", "data")


@query
def top_level_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session and trace at the top level win over the ones inside ``data``."""
    lines = sample_lines(spark, sf_dir).withColumn(
        "value",
        F.replace("value", F.lit(',"data":'), F.lit(',"session":"top","trace":"t1","data":')),
    )
    return usable_entries(lines).select("file", "source", "session", "error", "trace", "data")


@query
def epoch_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch texts of every shape: 1-13 digits, fractions of 0-11 digits."""
    sec, frac = F.col("sec").cast("string"), F.concat("frac", F.lit("123456"))
    n = F.col("event_id")
    stamp = (
        F.when(n % 5 == 0, F.substring(F.concat(sec, F.lit("999")), F.lit(1), n % 13 + 1))
        .when(n % 5 == 1, F.concat(F.lit("0"), sec))
        .otherwise(F.concat(sec, F.lit("."), F.substring(frac, F.lit(1), n % 12)))
    )
    stamps = event_parts(events(spark, sf_dir)).select("event_id", stamp.alias("stamp"))
    seconds = timestamps.epoch_seconds(F.col("stamp"))
    return stamps.select(
        "event_id",
        "stamp",
        seconds.alias("epoch_sec"),
        timestamps.epoch_nanos(F.col("stamp"), seconds).alias("nanos"),
    )


@query
def rfc3339_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3339 texts with zones, other fraction lengths and impossible dates."""
    n, clock = F.col("event_id"), F.translate("clock", " ", "T")
    stamp = (
        F.when(n % 6 == 0, F.concat(clock, F.lit("Z")))
        .when(n % 6 == 1, F.concat(clock, F.lit("."), "frac", F.lit("789+02:00")))
        .when(n % 6 == 2, F.concat(clock, F.lit("."), F.substring("frac", 1, 2), F.lit("-05:30")))
        .when(n % 6 == 3, F.concat(F.lit("2024-02-30"), F.substring(clock, 11, 9), F.lit("Z")))
        .when(n % 6 == 4, clock)
        .otherwise(F.col("rfc"))
    )
    stamps = event_parts(events(spark, sf_dir)).select("event_id", stamp.alias("stamp"))
    instant = timestamps.rfc3339_instant(F.col("stamp"))
    nanos = timestamps.rfc3339_nanos(F.col("stamp"), instant)
    return stamps.select(
        "event_id", "stamp", F.unix_seconds(instant).alias("epoch_sec"), nanos.alias("nanos")
    )


@query
def level_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, merge and print levels of both wire versions."""
    shapes = F.array(
        *map(F.lit, ("0", "1", "2", "3", "4", "debug", "info", "error", "fatal", "INFO", ""))
    )
    ev = events(spark, sf_dir).select(
        "event_id",
        F.element_at(shapes, (F.col("event_id") % 11 + 1).cast("int")).alias("v1_text"),
        F.element_at(shapes, (F.col("user_id") % 11 + 1).cast("int")).alias("v2_text"),
    )
    v1, v2 = levels.decode_level(F.col("v1_text")), levels.decode_level(F.col("v2_text"))
    merged = levels.merge_levels(v1, v2)
    return ev.select(
        "event_id",
        v1.alias("v1"),
        v2.alias("v2"),
        merged.alias("log_level"),
        levels.level_name(merged).alias("level_name"),
        levels.level_label(merged).alias("level_label"),
        levels.level_name(merged + F.col("event_id").cast("int") % 3).alias("shifted_name"),
    )


@query
def indented_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented ``data`` says the same as the compact one."""
    pretty = entry.indented_data(F.col("data"))
    return entries(spark, sf_dir).select(
        "file",
        F.to_json(F.parse_json(pretty)).alias("data"),
        (F.size(F.split(pretty, "\n"))).alias("data_lines"),
    )


# --- text ------------------------------------------------------------------------


@query
def strip_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample_lines(spark, sf_dir)
    return lines.select("file", text.strip_color(F.col("value")).alias("value"))


@query
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other two-byte introducers as well; the control-sequence form leaves them."""
    lines = sample_lines(spark, sf_dir).withColumn(
        "value", F.concat(F.lit("\x1bP1;2q"), "value", F.lit("\x1bD~"))
    )
    return lines.select(
        "file",
        text.strip_ansi(F.col("value")).alias("no_ansi"),
        text.strip_color(F.col("value")).alias("no_color"),
    )


@query
def strip_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    colored = F.replace("value", F.lit(" "), F.lit(f" {COLOR_ON}"))
    colored = F.concat(colored, F.lit(COLOR_OFF))
    return lines.select("doc_id", text.strip_color(colored).alias("value"))


@query
def stripped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured lines parse once their escape sequences are gone."""
    lines = sample_lines(spark, sf_dir)
    lines = lines.withColumn("value", text.strip_color(F.col("value")))
    return usable_entries(lines).select("file", *FIELDS)


@query
def display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec, nanos = F.col("epoch_sec"), F.col("nanos")
    return entries(spark, sf_dir).select(
        "epoch_sec",
        "nanos",
        timestamps.display_time(sec, nanos).alias("display"),
        timestamps.display_time(sec, nanos, "Asia/Kolkata").alias("display_local"),
        timestamps.rfc3339_text(sec, nanos).alias("rfc3339"),
        timestamps.rfc3339_text(sec, nanos, "Asia/Kolkata").alias("rfc3339_local"),
    )


@query
def padded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(
        text.pad_right(F.col("source"), sinks.SOURCE_WIDTH).alias("source"),
        text.pad_right(levels.level_label(F.col("log_level")), sinks.LEVEL_WIDTH).alias("level"),
        text.pad_right(F.col("session"), sinks.SESSION_WIDTH).alias("session"),
        text.pad_right(F.col("message"), 4).alias("message"),
    )


@query
def indent_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", text.indent_block(F.col("text"), sinks.BLOCK_INDENT).alias("block")
    )


@query
def component_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, COMPONENTS))
    index = (F.col("user_id") % len(COMPONENTS) + 1).cast("int")
    ev = events(spark, sf_dir).select(
        "event_id", F.concat(F.element_at(names, index), F.lit(":"), "event_type").alias("source")
    )
    return ev.select(
        "event_id",
        text.component(F.col("source")).alias("component"),
        text.component_color(F.col("source")).alias("color"),
    )


@query
def log_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(sample_lines(spark, sf_dir)).where(F.col("kind") == "raw")
    return parsed.select("raw", text.log_type(F.col("raw")).alias("log_type"))


# --- filters ---------------------------------------------------------------------


def _filtered(spark: SparkSession, sf_dir: str, condition) -> DataFrame:
    return entries(spark, sf_dir).where(condition).select("file", *FIELDS)


@query
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.time_range(RANGE_START, RANGE_END))


@query
def time_range_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = filters.time_range(RANGE_START, RANGE_END, closed="neither")
    return _filtered(spark, sf_dir, condition)


@query
def time_after_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided range with an epoch number as bound."""
    return _filtered(spark, sf_dir, filters.time_range(start=Decimal("1705000000.5")))


@query
def time_bound_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date without a year to a duration before a fixed moment."""
    now = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
    bounds = filters.time_range("01/10 06:00:00.50", dt.timedelta(days=-140), now=now)
    return _filtered(spark, sf_dir, bounds)


@query
def min_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.min_level("error"))


@query
def level_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.level_in(["info", 3]))


@query
def line_min_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_lines(spark, sf_dir).where(filters.line_min_level("error"))


@query
def pattern_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_lines(spark, sf_dir).where(matches(F.col("value"), "user-7"))


@query
def pattern_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = matches(F.col("value"), r"^[[:digit:]]{4}/01/(?P<day>1[0-9]) .*user-[0-9]+$")
    return sample_lines(spark, sf_dir).where(condition)


@query
def pattern_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.field_matches("source", ["purchase", "^sign.*:[02]$"]))


@query
def document_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return lines.where(matches_any(F.col("value"), ["the the", r"[0-9]{3}-[0-9]{4}"])).select(
        "doc_id", "value"
    )


def _four_letters(number: int) -> str:
    letters = []
    for _ in range(4):
        number, letter = divmod(number, 26)
        letters.append(chr(ord("a") + letter))
    return "".join(reversed(letters))


# Ten thousand literals: every 45th word of four letters, between blanks.
MANY_LITERALS = [f" {_four_letters(n)} " for n in range(0, 26**4, 45)]


@query
def literal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that hold one of ten thousand literals."""
    lines = document_lines(spark, sf_dir)
    return lines.where(matches_any(F.col("value"), MANY_LITERALS)).select("doc_id", "value")


@query
def page_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.select(
        "page_id",
        matches(F.col("html"), "<nav>").alias("has_nav"),
        matches(F.col("html"), r"<h[1-3][ >]").alias("has_heading"),
    )


@query
def conversation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.where(matches_any(F.col("text"), ["then", "und"])).select("conv_id", "turn", "role")


@query
def composite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = filters.entry_filter(
        start=RANGE_START,
        end=RANGE_END,
        level="info",
        fields={"source": ["signup:1"], "error": "boom", "data": '"k":9.'},
    )
    return _filtered(spark, sf_dir, condition)


@query
def composite_bounds_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.entry_filter(end=RANGE_START, level=1))


@query
def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = filters.line_filter({"source": "signup:1", "error": "bo+m"})
    return sample_lines(spark, sf_dir).where(condition)


@query
def contains_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(text.contains_ignore_case(F.col("text"), "ThE aNd")).select("doc_id", "lang")


# --- quality ---------------------------------------------------------------------


@query
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality.gate_counts(parse_lines(sample_lines(spark, sf_dir, "unit")))
    return counts.select(
        "file", "usable_lines", "bad_lines", quality.passes_gate().alias("kept")
    )


@query
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = quality.file_gate(parse_lines(sample_lines(spark, sf_dir, "unit")))
    return gated.select("file", *FIELDS)


@query
def file_gate_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when the dropped files are too many to broadcast."""
    parsed = parse_lines(sample_lines(spark, sf_dir, "unit"))
    return quality.file_gate(parsed, broadcast_bytes=0).select("file", *FIELDS)


@query
def gate_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with exactly 99 and exactly 100 bad lines, in turn."""
    block, nth = F.expr("event_id div 1000"), F.col("event_id") % 1000
    p = event_parts(events(spark, sf_dir))
    good = F.concat(F.lit('{"timestamp":"'), "epoch", F.lit('","source":"'), "src", F.lit('"}'))
    lines = p.select(
        F.concat(F.lit("bad-"), block.cast("string"), F.lit(".log")).alias("file"),
        F.when(nth < 99 + block % 2, F.lit("junk")).otherwise(good).alias("value"),
    )
    gated = quality.file_gate(parse_lines(lines))
    return gated.groupBy("file").agg(F.count("*").alias("entries"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.file_report(parse_lines(sample_lines(spark, sf_dir, "unit")))


@query
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sort_report(_report(spark, sf_dir), by="file")


@query
def mixed_file_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.with_error_ratio(quality.mixed_files(_report(spark, sf_dir)))
    report = quality.sort_report(report, by="ratio")
    hundredths = F.round(F.col("error_percent") * 100).cast("bigint")
    return report.withColumn("error_hundredths", hundredths).drop("error_percent")


@query
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_counts(document_lines(spark, sf_dir), "lang")


@query
def all_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_counts(document_lines(spark, sf_dir), "lang", count_empty=True)


@query
def candidate_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample_lines(spark, sf_dir)
    regex = r'level":\s*(?:[123]|"(info|error|fatal)")'
    return quality.matching_line_counts(lines, regex, "file")


# --- merge, compare, de-duplicate, sort -------------------------------------------


@query
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag union of two sets of files."""
    both = combine.merge([entries(spark, sf_dir, "node"), entries(spark, sf_dir, "unit")])
    return both.select("file", *FIELDS)


@query
def same_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event written in both wire versions parses to the same entry, unless the
    second one is given another level."""
    p = event_parts(events(spark, sf_dir))
    tail = F.concat(
        F.lit('"source":"'), "src", F.lit('","message":"'), "msg", F.lit('","data":'), "data",
        F.lit("}"),
    )
    name = F.when(F.col("event_id") % 5 == 0, F.lit("fatal")).otherwise(F.col("name"))
    versions = F.array(
        F.concat(F.lit('{"timestamp":"'), "epoch", F.lit('","log_level":'), F.col("lvl"), F.lit(","), tail),
        F.concat(F.lit('{"timestamp":"'), "rfc", F.lit('","level":"'), name, F.lit('",'), tail),
    )
    lines = p.select("event_id", F.posexplode(versions).alias("version", "value"))
    parsed = parse_lines(lines)
    fields = F.struct(*FIELDS)
    pairs = parsed.groupBy("event_id").agg(
        F.max_by(fields, -F.col("version")).alias("v1"), F.max_by(fields, "version").alias("v2")
    )
    return pairs.select("event_id", combine.same_entry("v1", "v2").alias("same"))


@query
def unique_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.unique_by_time(entries(spark, sf_dir)).drop("timestamp")


@query
def time_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.sort_by_time(entries(spark, sf_dir).select("file", *FIELDS))


@query
def combined_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, gate, filter, de-duplicate and sort in one go."""
    lines = sample_lines(spark, sf_dir, "unit").withColumn("member", F.lit(None).cast("string"))
    combined = entries_of(lines, gate=True, where=filters.min_level("info"), unique=True)
    return combined.drop("timestamp")


# --- sinks -----------------------------------------------------------------------


@query
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(sinks.json_line().alias("line"))


@query
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written JSON lines read back as the same entries."""
    path = scratch_path(spark, "json")
    sinks.write_json_lines(entries(spark, sf_dir), path, compression="gzip")
    return usable_entries(read_lines(spark, path)).select(*FIELDS)


@query
def pretty_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(sinks.pretty_text().alias("text"))


@query
def pretty_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(sinks.pretty_text(color=False).alias("text"))


@query
def pretty_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the written readable text."""
    path = scratch_path(spark, "pretty")
    sinks.write_pretty(combine.sort_by_time(entries(spark, sf_dir)), path, color=False)
    return read_lines(spark, path).select("value")


@query
def stripped_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stripped")
    sinks.write_stripped(sample_lines(spark, sf_dir), path)
    return read_lines(spark, path).select("value")


@query
def report_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    report = quality.sort_report(_report(spark, sf_dir))
    sinks.write_report(report, path)
    return spark.read.parquet(path)


# --- sources ---------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, *kinds: str) -> str:
    """Folder with the sample lines once per kind of file."""
    folder = scratch_path(spark, "logs")
    lines = sample_lines(spark, sf_dir)
    for kind in kinds:
        write_files(lines, folder, kind)
    return folder


@query
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "text")
    sample_lines(spark, sf_dir).select("value").write.text(path)
    return read_lines(spark, path).select("value")


@query
def text_files_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "text")
    sample_lines(spark, sf_dir).select("value").write.text(path)
    return read_lines(spark, path, strip=True).select("value")


@query
def gzip_and_bzip2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots, one per codec, read as one table."""
    lines, roots = sample_lines(spark, sf_dir).select("value"), []
    for codec in ("gzip", "bzip2"):
        roots.append(scratch_path(spark, codec))
        lines.write.option("compression", codec).text(roots[-1])
    return read_lines(spark, roots).select("value")


@query
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as text and read back line by line, empty lines too."""
    path = scratch_path(spark, "documents")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    docs.write.text(path)
    lines = read_lines(spark, path, keep_empty=True)
    return lines.groupBy("value").agg(F.count("*").alias("lines"))


@query
def xz_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir, "xz")
    return archives.complete_files(archives.read_streamed(spark, folder)).select("value")


@query
def tar_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, compressed and nested archives; every line comes once from each."""
    folder = _written(spark, sf_dir, "tar", "tgz", "nested")
    selection = FileSelection()
    lines = archives.read_streamed(spark, folder, selection=selection, piece_bytes=1 << 16)
    return archives.complete_files(lines).select("value")


@query
def repeated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose members all have one name: each member is read."""
    folder = _written(spark, sf_dir, "repeats")
    lines = archives.read_streamed(spark, folder, selection=FileSelection())
    return archives.complete_files(lines).select("member", "value")


@query
def default_log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default names leave the xz files out."""
    folder = _written(spark, sf_dir, "log", "gz", "xz")
    return read_lines(spark, folder, selection=FileSelection()).select("value")


@query
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include, exclude and excluded directories over one directory per node."""
    path = scratch_path(spark, "my nodes+é")
    lines = sample_lines(spark, sf_dir).withColumn("node", F.concat(F.lit("a b+é%"), "file"))
    lines.drop("file").write.partitionBy("node").text(path)
    # Spark writes the percent sign of a partition value as %25; the name is just that.
    selection = FileSelection(
        include=["part-*"],
        exclude=["*.gz"],
        exclude_dir=["node=a b+é%25node-[1-3].log", "*-7*", "my nodes*"],
    )
    return read_lines(spark, path, selection=selection).select("value")


@query
def file_name_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs as a predicate on a name column."""
    lines = sample_lines(spark, sf_dir)
    return lines.where(glob_matches_any(F.col("file"), ["node-[0-2].log", "*-?8.log", "*9*"]))


@query
def damaged_files_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing of a damaged gzip file is kept, everything of the sound ones is."""
    folder = _written(spark, sf_dir, "log", "damaged")
    return archives.complete_files(read_tree(spark, folder)).select("value")


def _unit_files(spark: SparkSession, sf_dir: str, *codecs: str) -> str:
    """Folder with the lines of each block in one file per codec; all blocks are small."""
    folder = scratch_path(spark, "units")
    write_unit_files(sample_lines(spark, sf_dir, "block").withColumnRenamed("file", "unit"), folder, *codecs)
    return folder


UNIT_FILES = FileSelection(include=["part-*"])


@query
def combine_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over plain and gzip logs, poor files dropped: one entry per event."""
    folder = _unit_files(spark, sf_dir, "none", "gzip")
    return combine_logs(spark, folder, selection=UNIT_FILES, unique=True).drop("timestamp")


@query
def overlapping_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root given twice: each reading of a file is gated by itself."""
    folder = _unit_files(spark, sf_dir, "none")
    entries = combine_logs(spark, [folder, f"{folder}/none"], selection=UNIT_FILES, sort=False)
    return entries.select(*FIELDS)


@query
def dropped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole job says about every file it read, damaged ones included."""
    folder = _unit_files(spark, sf_dir, "none")
    write_files(sample_lines(spark, sf_dir), folder, "damaged")
    files = combine_job(
        spark, folder, selection=FileSelection(include=["part-*", "broken-*"])
    ).files
    damaged = F.contains("file", F.lit("/broken-"))
    # However many damaged files there are, they make one row.
    return files.select(
        F.when(damaged, "damaged").otherwise(F.regexp_extract("file", "unit=([^/]+)", 1)).alias("file"),
        # How many lines come before a fault depends on the sizes of reads.
        *[F.when(damaged, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("usable_lines", "bad_lines")],
        F.col("read_error").isNotNull().alias("failed"),
        "kept",
    ).distinct()


@query
def hidden_below_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same below roots with wildcards, in folders and named by the wildcard itself."""
    folder = scratch_path(spark, "wild")
    lines = sample_lines(spark, sf_dir)
    for place, kind in (("a-1/_b/c", "log"), ("a-2", "underscore"), ("a-3/.d", "log"), ("e", "underscore"), ("f/g", "dot")):
        write_files(lines, f"{folder}/{place}", kind)
    roots = [f"{folder}/a-[1-3]", f"{folder}/{{e,f}}/*"]
    return read_tree(spark, roots, selection=FileSelection(include=["*.log"])).select("value")


@query
def hidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names starting with an underscore are read, those starting with a dot are not."""
    folder = _written(spark, sf_dir, "log", "underscore", "dot")
    return read_tree(spark, folder, selection=FileSelection(include=["*.log"])).select("value")


@query
def single_file_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gzip file named outright: no gate, colours removed before the parse."""
    folder = scratch_path(spark, "one")
    lines = sample_lines(spark, sf_dir).select("value")
    write_files(lines.coalesce(1), folder, "gz")
    entries = combine_logs(spark, f"{folder}/app-0.log.1.gz", strip=True, sort=False)
    return entries.select(*FIELDS)


# --- streaming -------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "arriving")
    sample_lines(spark, sf_dir).select("value").write.text(path)
    return stream_lines(spark, path)


def _finish(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there and give its output."""
    out = scratch_path(spark, "streamed")
    run = (
        stream.select(*FIELDS)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)


@query
def stream_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _streamed(spark, sf_dir)
    return _finish(spark, streaming.stream_entries(lines, where=filters.min_level("info")))


@query
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in time order, one a batch, so that a short delay lets old state go."""
    path, days = scratch_path(spark, "arriving"), F.dayofmonth("ts")
    for first in (1, 9, 17, 25):
        part = events(spark, sf_dir).where((days >= first) & (days < first + 8))
        log_lines(part).select("value").coalesce(1).write.mode("append").text(path)
    arriving = stream_lines(spark, path, max_files_per_trigger=1)
    return _finish(spark, streaming.stream_unique(streaming.stream_entries(arriving), "1 hour"))


@query
def stream_sorted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "batches")
    found = streaming.stream_entries(_streamed(spark, sf_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.select(*FIELDS).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run = (
        streaming.write_stream_sorted(found, write_batch)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select(*FIELDS)


@query
def stream_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream-json")
    found = streaming.stream_entries(_streamed(spark, sf_dir))
    run = (
        streaming.write_stream_text(
            found, sinks.json_line(), out, scratch_path(spark, "stream-state")
        )
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.text(out).select(F.col("value").alias("line"))
