"""Parse one log line into an entry, entirely with built-in expressions.

The line is wrapped as ``[line, {sentinel}]`` before it goes to ``from_json``. Text
after the object then breaks the array or moves the sentinel, so a line counts as
JSON only when the whole of it is one object.

``from_json`` reads a text field from a JSON number or object as well, which would let
wrong types through. Only a few texts can have come about that way, so those lines, and
no others, are parsed a second time into a VARIANT, which tells types apart and keeps
numbers exact.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logspark.session import ship_package

# Keys of the wire format.
STRING_KEYS = ("source", "message", "session", "error", "trace")
SCALAR_KEYS = ("timestamp", "log_level", "level")
WIRE_KEYS = (*SCALAR_KEYS, *STRING_KEYS, "data")
LIFTED_KEYS = ("session", "trace", "error")
UNSURE_KEYS = ("timestamp", *STRING_KEYS)

# Fixed value: spaces and the opening brace a JSON candidate starts with.
CANDIDATE = r"^[ \t\r\n]*\{"

# Texts of a time that do not come from a number with a fraction or exponent.
SURE_TIME = r"^(?:[1-9][0-9]{7,}\.[0-9]+|[0-9]+|[0-9]{4}-.*)\z"
# Texts that a JSON number, boolean, object or array also turns into.
NOT_SURELY_STRING = (
    r'(?s)^(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|"?-?Infinity"?|true|false|[\[{].*)\z'
)

_SENTINEL = "\x7fend-of-line"
_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    # The reader's own limits would turn long but valid lines into raw ones.
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "maxNestingDepth": "10000",
}

# Brackets that may be open at once in what is parsed into a VARIANT. That parser calls
# itself for each, and a line that exhausted a thread's stack would end the whole session.
MAX_DEPTH = 500
# Fixed value: nesting from which on a line is no JSON at all.
NESTING_LIMIT = 10_000
# Strings, and what lies between two brackets; Java matches these without recursion.
_STRING = r'(?s:"[^"\\]*+(?:\\.[^"\\]*+)*+"?)'
_BETWEEN = rf'(?:{_STRING}|[^"\[\]{{}}]++)'
# Brackets around a member of ``data``: the line's and its own.
_MEMBER_LEVEL = 2


def may_be_json(line: Column) -> Column:
    """True if the first character after blanks is an opening brace."""
    return line.rlike(CANDIDATE)


def _worth_parsing(line: Column) -> Column:
    """False for lines that cannot be one JSON object, told from the text alone.

    A failing parse costs many times a good one, so the common kinds of broken line
    are kept from it: text after the last brace, and raw escape characters.
    """
    ends = F.endswith(F.rtrim(line, F.lit(" \t\r\n")), F.lit("}"))
    return may_be_json(line) & ends & ~F.contains(line, F.lit("\x1b"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def deep_parts(line: Column) -> Column:
    """For JSON candidates nested beyond :data:`MAX_DEPTH` how to read them; NULL for others.

    Running sums over the runs of brackets outside strings that open or close give the depth
    after each: ``depth`` is the largest, and ``closed`` says that all are closed. Members of
    ``data`` (and other values at their level) that reach too deep are cut out of the line:
    ``pieces`` are their texts, and ``shallow`` has an array with one marker in their places, so
    that no type that matters changes. Short lines and lines of few brackets are settled at once,
    and only lines that are too deep are taken apart.
    """
    many = line.rlike(rf"^(?:[^\[{{]*+[\[{{]){{{MAX_DEPTH + 1}}}+")
    suspect = (F.octet_length(line) > 2 * MAX_DEPTH) & many & _worth_parsing(line)
    span = "array<struct<first:int,last:int>>"
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("most"), F.lit(0).alias("first"),
        F.lit(0).alias("inside"), F.expr(f"CAST(array() AS {span})").alias("spans"),
    )

    def step(sums: Column, run: Column) -> Column:
        """Sums after a run; ``at``, ``first`` and ``last`` count brackets."""
        opens, before = F.left(run, F.lit(1)).isin("[", "{"), sums["open"]
        after = before + F.when(opens, F.length(run)).otherwise(-F.length(run))
        begins = opens & (before <= _MEMBER_LEVEL) & (after > _MEMBER_LEVEL)
        ends = ~opens & (before > _MEMBER_LEVEL) & (after <= _MEMBER_LEVEL) & (sums["inside"] > MAX_DEPTH)
        # Where the member level is left in this run, upwards or downwards.
        edge = sums["at"] + F.when(opens, _MEMBER_LEVEL + 1 - before).otherwise(before - _MEMBER_LEVEL)
        found = F.array(F.struct(sums["first"].alias("first"), edge.alias("last")))
        return F.struct(
            (sums["at"] + F.length(run)).alias("at"), after.alias("open"), F.greatest(sums["most"], after).alias("most"),
            F.when(begins, edge).otherwise(sums["first"]).alias("first"),
            F.when(begins, after).otherwise(F.greatest(sums["inside"], after)).alias("inside"),
            F.when(ends, F.concat(sums["spans"], found)).otherwise(sums["spans"]).alias("spans"),
        )

    def head(text: Column, brackets: Column) -> Column:
        """The text up to and with this many brackets."""
        pattern = F.concat(F.lit(rf"^(?:{_BETWEEN}*+[\[\]{{}}]){{"), brackets.cast("string"), F.lit("}+"))
        return F.call_function("regexp_extract", text, pattern, F.lit(0))

    def rest(text: Column, head: Column) -> Column:
        return F.substring(text, F.length(head) + 1, F.length(text))

    def cut_span(made: Column, span: Column) -> Column:
        def with_head(head_text: Column) -> Column:
            kept = F.left(head_text, F.length(head_text) - 1)
            begun = F.concat(F.right(head_text, F.lit(1)), rest(made["rest"], head_text))
            return _let(F.struct(kept.alias("kept"), begun.alias("begun")), with_begun)

        def with_begun(t: Column) -> Column:
            piece = head(t["begun"], span["last"] - span["first"] + 1)
            return _let(piece, lambda piece: F.struct(
                span["last"].alias("at"),
                rest(t["begun"], piece).alias("rest"),
                F.concat(made["text"], t["kept"], deep_marker(line, F.size(made["pieces"]) + 1)).alias("text"),
                F.concat(made["pieces"], F.array(piece)).alias("pieces"),
            ))

        return _let(head(made["rest"], span["first"] - made["at"]), with_head)

    def cut(sums: Column) -> Column:
        whole = F.struct(
            F.lit(0).alias("at"), line.alias("rest"), F.lit("").alias("text"),
            F.expr("CAST(array() AS array<string>)").alias("pieces"),
        )
        return _let(F.aggregate(sums["spans"], whole, cut_span), lambda made: F.struct(
            sums["most"].alias("depth"),
            (sums["open"] == 0).alias("closed"),
            F.concat(made["text"], made["rest"]).alias("shallow"),
            made["pieces"].alias("pieces"),
        ))

    brackets = F.regexp_replace(line, f"{_BETWEEN}++", "")
    runs = F.regexp_extract_all(brackets, F.lit(r"[\[{]++|[\]}]++"), F.lit(0))
    sums = F.aggregate(runs, start, step)
    return F.when(suspect, _let(sums, lambda sums: F.when(sums["most"] > MAX_DEPTH, cut(sums))))


def deep_marker(line: Column, number: Column) -> Column:
    """What stands for the piece of this number; no line holds the hash of itself."""
    return F.concat(F.lit('["deep:'), F.xxhash64(line).cast("string"), F.lit(":"), number.cast("string"), F.lit('"]'))


def sound_pieces(pieces: Column) -> Column:
    """True if cut-out pieces are JSON. The reader passes over them without making values."""
    skipped = F.concat(F.lit('{"skip":['), F.array_join(pieces, ","), F.lit('],"end":true}'))
    return F.from_json(skipped, "end boolean", _OPTIONS)["end"]


def parsed_line(line: Column, deep: Column, sound: Column) -> Column:
    """The text that is parsed for a line: without deep values, and NULL if they are broken."""
    return F.when(deep.isNull(), line).when(sound, deep["shallow"])


def with_pieces(data: Column, line: Column, pieces: Column) -> Column:
    """``data`` with its deep pieces again in their places; keys inside them keep their order."""
    def compact(piece: Column) -> Column:
        return F.regexp_replace(piece, f"({_STRING})|[ \\t\\r\\n]++", "$1")

    numbers = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)))
    restored = F.aggregate(
        numbers, data, lambda text, n: F.replace(text, deep_marker(line, n), F.coalesce(compact(F.get(pieces, n - 1)), F.lit("")))
    )
    return F.when(pieces.isNull(), data).otherwise(restored)


def wrapped_line(line: Column, case_insensitive_keys: bool = False) -> Column:
    """JSON candidates parsed as ``[line, sentinel]``; NULL for broken JSON."""
    wrapped = F.when(
        _worth_parsing(line), F.concat(F.lit("["), line, F.lit(f',{{"{_SENTINEL}":true}}]'))
    )
    types = {key: "string" for key in WIRE_KEYS} | {"data": "variant", _SENTINEL: "boolean"}
    fields = ",".join(f"`{key}`:{type}" for key, type in types.items())
    item = "map<string,variant>" if case_insensitive_keys else f"struct<{fields}>"
    return F.from_json(wrapped, f"array<{item}>", _OPTIONS)


def whole_line(wrapped: Column) -> Column:
    """True if a line parsed by :func:`wrapped_line` was one object and nothing else."""
    ended = F.get(wrapped, F.lit(1))[_SENTINEL].isNotNull()
    return F.coalesce((F.size(wrapped) == 2) & ended, F.lit(False))


def wire_fields(wrapped: Column) -> dict[str, Column]:
    """The nine wire fields: ``data`` as VARIANT, the others as text."""
    record = F.get(wrapped, F.lit(0))
    return {key: record[key] for key in WIRE_KEYS}


def any_case_fields(wrapped: Column) -> dict[str, Column]:
    """The nine wire fields as VARIANT, found by keys in any case.

    Of several spellings of one key the last one counts.
    """
    lowered = F.transform(
        F.reverse(F.map_entries(F.get(wrapped, F.lit(0)))),
        lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")),
    )

    def last(key: str) -> Column:
        return F.get(F.filter(lowered, lambda e: e["k"] == key), F.lit(0))["v"]

    return {key: last(key) for key in WIRE_KEYS}


def unsure(key: str, text: Column) -> Column:
    """True if the text of a field may stand for JSON of another type.

    A level is checked against a list that such texts are not on. For a time, both
    a string and a number are fine; what matters is that a number with a fraction has
    gone through a DOUBLE, whose text never has eight digits before a dot.
    """
    if key == "timestamp":
        return ~text.rlike(SURE_TIME)
    if key in STRING_KEYS:
        return text.rlike(NOT_SURELY_STRING)
    return F.lit(False)


def exact_fields(line: Column) -> dict[str, Column]:
    """The wire fields that can be unsure, as VARIANT, from a line parsed once more."""
    fields = ",".join(f"`{key}` variant" for key in UNSURE_KEYS)
    parsed = F.from_json(line, fields, _OPTIONS)
    return {key: parsed[key] for key in UNSURE_KEYS}


def is_absent(value: Column) -> Column:
    """True for a missing key and for JSON null."""
    return value.isNull() | F.is_variant_null(value)


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def scalar_text(value: Column) -> Column:
    """Text of a quoted or bare scalar, NULL for other JSON.

    A bare number with a dot keeps its dot even when the fraction is zero, so that
    ``1.0`` cannot be taken for ``1``.
    """
    text = value.cast("string")
    kind = _type(value)
    dotted = F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".0")))
    return (
        F.when(kind == "STRING", text)
        .when(kind == "BIGINT", text)
        .when(kind.startswith("DECIMAL"), dotted)
    )


def string_value(value: Column) -> Column:
    """Text of a JSON string, NULL for any other JSON."""
    return F.when(_type(value) == "STRING", value.cast("string"))


def strict_text(key: str, value: Column) -> Column:
    """Text of a VARIANT field under the type rule of its key."""
    return string_value(value) if key in STRING_KEYS else scalar_text(value)


def object_members(value: Column) -> Column:
    """Members of a JSON object as a map, NULL for any other JSON."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def first_text(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts])


def residual_members(members: Column, keep_nonstring: bool = False) -> Column:
    """Members of ``data`` without the lifted keys.

    The lifted keys go even when their value is not a string; ``keep_nonstring``
    leaves those values in place instead.
    """
    def stays(key: Column, value: Column) -> Column:
        other = ~key.isin(*LIFTED_KEYS)
        if not keep_nonstring:
            return other
        return other | ~(is_absent(value) | (_type(value) == "STRING"))

    return F.map_filter(members, stays)


def compact_json(members: Column) -> Column:
    """Compact JSON of the members with sorted keys, NULL if there are none."""
    return F.when(F.size(members) > 0, F.to_json(members))


_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _indent_json(text: str, prefix: str, indent: str) -> str:
    """Lay compact JSON out over lines; the tokens themselves stay as they are."""
    tokens, out, depth = _JSON_TOKEN.findall(text), [], 0
    for before, token in zip(["", *tokens], tokens):
        depth -= token in "}]"
        opened, closes = before in ("{", "["), token in ("}", "]")
        if (opened and not closes) or before == "," or (closes and not opened):
            out.append("\n" + prefix + indent * depth)
        out.append(token + " " if token == ":" else token)
        depth += token in "{["
    return "".join(out)


def indented_data(data: Column, prefix: str = "", indent: str = "    ") -> Column:
    """``data`` over several lines, nested values included.

    Spark prints nested VARIANT values on one line only, so the layout is done by an
    Arrow-batched Python function. For display; nothing else in the library calls it.
    """
    @F.pandas_udf("string")
    def lay_out(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _indent_json(t, prefix, indent), na_action="ignore")

    ship_package(SparkSession.active())
    return lay_out(data)
