"""SQL that computes what the registered queries compute, for another engine.

The SQL spells the line rules of :mod:`logspark.plans.sample_lines` and the parse rules
a second time; nothing is shared with the Spark code but constants.
"""

from __future__ import annotations

from logspark.functions.text import COMPONENT_COLORS

FIELD_LIST = "epoch_sec, nanos, log_level, source, message, session, error, trace, data"

PARTS = r"""
p0 AS (
  SELECT *, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock,
    CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 3 ELSE 0 END AS lvl
  FROM events),
p1 AS (
  SELECT *, us // 1000000 AS sec, lpad((us % 1000000)::VARCHAR, 6, '0') AS frac,
    event_type || ':' || (user_id % 4) AS src FROM p0),
parts AS (
  SELECT *,
    'node-' || (user_id % 10) || '.log' AS node,
    'unit-' || length(bin(event_id % 1024)) || '.log' AS unit,
    sec || '.' || frac || '000' AS epoch,
    replace(clock, ' ', 'T') || '.' || frac || 'Z' AS rfc,
    event_type || '.user-' || user_id AS msg,
    ['debug', 'info', 'error', 'fatal'][lvl + 1] AS name,
    '{"session":"' || user_id || '.' || (event_id % 7) || '"' ||
      CASE WHEN event_type = 'error' THEN ',"error":"boom"' ELSE '' END ||
      ',"cents":' || CAST(round(value * 100) AS BIGINT) || ',"props":' || props || '}' AS datas
  FROM p1)"""

LINES = PARTS + r""",
l0 AS (
  SELECT *,
    CASE WHEN event_id % 23 = 0 THEN '7'
      WHEN event_id % 13 = 0 THEN '"' || chr(27) || '[01;31m' || chr(27) || '[K' || src ||
        chr(27) || '[m' || chr(27) || '[K"'
      ELSE '"' || src || '"' END AS j_source,
    CASE WHEN event_id % 29 = 0 AND event_id % 3 = 0 THEN '"timestamp":"5",'
      WHEN event_id % 29 = 0 AND event_id % 3 = 1 THEN '"timestamp":"' || sec || '000",'
      WHEN event_id % 29 = 0 THEN ''
      WHEN event_id % 2 = 0 THEN '"timestamp":"' || epoch || '",'
      ELSE '"timestamp":"' || rfc || '",' END AS j_time,
    CASE WHEN event_id % 2 = 0 THEN '"log_level":' || lvl ELSE '"level":"' || name || '"' END AS j_level
  FROM parts),
l1 AS (
  SELECT *, '{' || j_time || '"source":' || j_source || ',"message":"' || msg || '",' || j_level ||
    ',"data":' || datas AS body FROM l0),
l2 AS (
  SELECT *,
    CASE WHEN event_id % 17 = 0 AND event_id % 3 = 0 THEN replace(clock, '-', '/') || ' started ' || msg
      WHEN event_id % 17 = 0 AND event_id % 3 = 1 THEN replace(clock, '-', '/') || ' [error] 12#0: *1 ' || msg
      WHEN event_id % 17 = 0 THEN event_type || '.example - [' || clock[9:10] || '/Jan/' ||
        clock[1:4] || ':' || clock[12:19] || ' +0000] GET /'
      WHEN event_id % 19 = 0 AND event_id % 2 = 0 THEN body
      WHEN event_id % 19 = 0 THEN body || '} trailing'
      ELSE body || '}' END AS line FROM l1),
lines AS (
  SELECT node, unit, event_id, line AS value
  FROM l2, generate_series(1, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END))"""

SECONDS = (
    "CASE WHEN regexp_full_match({t}, '[1-9][0-9]{{1,9}}|[1-9][0-9]*\\.[0-9]{{1,9}}') "
    "THEN try_cast(split_part({t}, '.', 1) AS BIGINT) END"
)
NANOS = (
    "CASE WHEN {s} IS NOT NULL THEN CASE WHEN contains({t}, '.') "
    "THEN CAST(rpad(split_part({t}, '.', 2), 9, '0') AS INTEGER) ELSE 0 END END"
)
LEVEL = (
    "CASE {t} WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN 'debug' THEN 0 "
    "WHEN 'info' THEN 1 WHEN 'error' THEN 2 WHEN 'fatal' THEN 3 END"
)


def parsed(value: str = "value", lines: str = LINES, keep_error: bool = False) -> str:
    """CTE ``parsed``: the entry columns of every line."""
    patch = '{"session":null,"trace":null}' if keep_error else '{"session":null,"error":null,"trace":null}'
    return lines + rf""",
v AS (SELECT * REPLACE ({value} AS value) FROM lines),
j AS (SELECT *, CASE WHEN left(value, 1) = '{{' AND json_valid(value) THEN value::JSON END AS o FROM v),
f AS (
  SELECT *, json_extract_string(o, '$.timestamp') AS t, json_type(o, '$.source') AS source_type,
    json_extract_string(o, '$.source') AS src_, json_extract_string(o, '$.message') AS msg_,
    greatest(coalesce({LEVEL.format(t="json_extract_string(o, '$.log_level')")}, 0),
             coalesce({LEVEL.format(t="json_extract_string(o, '$.level')")}, 0)) AS lvl_,
    coalesce(json_extract_string(o, '$.session'), json_extract_string(o, '$.data.session')) AS session_,
    CASE WHEN json_type(o, '$.data.error') = 'VARCHAR' THEN json_extract_string(o, '$.data.error') END AS error_,
    json_extract_string(o, '$.trace') AS trace_,
    CAST(json_merge_patch(json_extract(o, '$.data'), '{patch}') AS VARCHAR) AS data_
  FROM j),
e AS (
  SELECT *, {SECONDS.format(t="t")} AS e_sec,
    CASE WHEN t LIKE '____-__-__T%Z' THEN epoch_us(try_cast(rtrim(t, 'Z') AS TIMESTAMP)) END AS r_us FROM f),
k AS (
  SELECT *, CASE WHEN o IS NULL OR source_type <> 'VARCHAR' OR
      (t IS NOT NULL AND e_sec IS NULL AND r_us IS NULL) THEN 'raw'
    WHEN t IS NULL THEN 'no_timestamp' ELSE 'lager' END AS kind FROM e),
parsed AS (
  SELECT node, unit, kind, event_id, value,
    CASE WHEN kind = 'lager' THEN coalesce(e_sec, r_us // 1000000) END AS epoch_sec,
    CASE WHEN kind = 'lager' THEN coalesce({NANOS.format(t="t", s="e_sec")},
      CAST((r_us % 1000000) * 1000 AS INTEGER)) END AS nanos,
    CASE WHEN kind <> 'raw' THEN lvl_ END AS log_level,
    CASE WHEN kind <> 'raw' THEN ['debug', 'info', 'error', 'fatal'][lvl_ + 1] END AS level_name,
    CASE WHEN kind <> 'raw' THEN src_ END AS source,
    CASE WHEN kind <> 'raw' THEN msg_ END AS message,
    CASE WHEN kind <> 'raw' THEN session_ END AS session,
    CASE WHEN kind <> 'raw' THEN error_ END AS error,
    CASE WHEN kind <> 'raw' THEN trace_ END AS trace,
    CASE WHEN kind <> 'raw' THEN data_ END AS data,
    CASE WHEN kind = 'raw' THEN value END AS raw
  FROM k)"""


def over_lines(select: str) -> str:
    return f"WITH {LINES} {select}"


def over_parts(select: str) -> str:
    return f"WITH {PARTS} {select}"


def over_parsed(select: str, **how) -> str:
    return f"WITH {parsed(**how)} {select}"


def over_entries(select: str, **how) -> str:
    return f"WITH {parsed(**how)}, entries AS (SELECT * FROM parsed WHERE kind = 'lager') {select}"


def where_entries(condition: str) -> str:
    return over_entries(f"SELECT node AS file, {FIELD_LIST} FROM entries WHERE {condition}")


AFTER_START = "epoch_sec >= 1704844800"
BEFORE_END = "(epoch_sec < 1705753800 OR (epoch_sec = 1705753800 AND nanos <= 1))"
NO_COLOR = r"regexp_replace({v}, chr(27) || '\[[0-?]*[ -/]*[@-~]', '', 'g')"
NO_ANSI = r"regexp_replace({v}, chr(27) || '[@-_][0-?]*[ -/]*[@-~]', '', 'g')"
PAD = "CASE WHEN length({v}) < {n} THEN rpad({v}, {n}, ' ') ELSE {v} END"
UTC = "make_timestamp(epoch_sec * 1000000)"
LOCAL = "make_timestamp((epoch_sec + 19800) * 1000000)"
FRACTION = "CASE WHEN nanos > 0 THEN rtrim('.' || lpad(nanos::VARCHAR, 9, '0'), '0') ELSE '' END"
RFC = f"strftime({UTC}, '%Y-%m-%dT%H:%M:%S') || {FRACTION}"
DISPLAY = "strftime({t}, '%m/%d %H:%M:%S') || '.' || left(lpad(nanos::VARCHAR, 9, '0'), 2)"
DOC_LINES = "doc_lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS value FROM documents)"
UNIQUE = f"SELECT DISTINCT {FIELD_LIST}, level_name FROM entries"
GATE = """counts AS (SELECT unit, count(*) FILTER (kind = 'lager') AS usable_lines,
    count(*) FILTER (kind <> 'lager') AS bad_lines FROM parsed GROUP BY unit),
  kept AS (SELECT unit FROM counts WHERE bad_lines < 100 AND usable_lines > 0)"""
BLOCK = """'block-' || event_id // 1200 || CASE WHEN event_id % 1200 < 600 THEN '-a.log'
    WHEN event_id % 1200 < 900 THEN '-b.log' ELSE '-c.log' END"""
BLOCKS = f"blocks AS (SELECT * REPLACE ({BLOCK} AS unit) FROM parsed), " + GATE.replace("parsed", "blocks")
GATED = "SELECT * FROM parsed WHERE kind = 'lager' AND unit IN (SELECT unit FROM kept)"
BLOCKS_GATED = GATED.replace("parsed", "blocks")
REPORT = """report AS (SELECT unit AS file, count(*) AS total_lines,
    count(*) FILTER (kind = 'raw') AS error_lines,
    count(*) FILTER (kind = 'lager') AS valid_lines FROM parsed GROUP BY unit)"""
JSON_LINE = f"""'{{"timestamp":"' || {RFC} || 'Z","log_level":"' || level_name || '","source":"' || source ||
    '","message":"' || message || '","session":"' || session ||
    CASE WHEN error IS NULL THEN '' ELSE '","error":"' || error END || '","data":' || data || '}}'"""


def _pretty(color: bool) -> str:
    def paint(code: str, value: str) -> str:
        return f"chr(27) || '{code}' || {value} || chr(27) || '[0m'" if color else value

    label = "'[' || upper(level_name) || ']'"
    level = paint("[0m", PAD.format(v=label, n=7))
    if color:
        level = (
            "chr(27) || CASE log_level WHEN 0 THEN '[90m' WHEN 1 THEN '[0m' ELSE '[91m' END || "
            f"{PAD.format(v=label, n=7)} || chr(27) || '[0m'"
        )
    error = paint("[91m", "repeat(' ', 27) || error || chr(10)")
    return " || ' ' || ".join(
        [
            paint("[0m", PAD.format(v="source", n=16)),
            level,
            paint("[0m", DISPLAY.format(t=UTC)),
            paint("[90m", PAD.format(v="session", n=10)),
            paint("[0m", "message"),
        ]
    ) + (
        f" || chr(10) || CASE WHEN error IS NULL THEN '' ELSE {error} END"
        " || repeat(' ', 27) || data || chr(10)"
    )


def _any_case() -> str:
    """Renaming keys does not change what the lines say."""
    return where_entries("TRUE")


def _colors() -> str:
    arms = " ".join(
        f"WHEN '{name}' THEN chr(27) || '{code[1:]}'" for name, code in COMPONENT_COLORS.items()
    )
    names = ", ".join(f"'{name}'" for name in (*COMPONENT_COLORS, "other"))
    return f"""WITH c AS (SELECT event_id, [{names}][user_id % {len(COMPONENT_COLORS) + 1} + 1] AS component
      FROM events)
    SELECT event_id, component, CASE component {arms} ELSE chr(27) || '[0m' END AS color FROM c"""


OBJECT_ERROR = """replace(value, '"error":"boom"', '"error":{{"code":7}}')""".replace("{{", "{").replace("}}", "}")
TOP_FIELDS = """replace(value, ',"data":', ',"session":"top","trace":"t1","data":')"""
ALL_LINES = over_lines("SELECT value FROM lines")
ENTRY_FIELDS = over_entries(f"SELECT {FIELD_LIST} FROM entries")

ORACLES: dict[str, str] = {
    "entry_counts": over_entries(
        "SELECT source, level_name, count(*) AS entries FROM entries GROUP BY ALL"
    ),
    "parse_entries": over_parsed(
        f"""SELECT node AS file, {FIELD_LIST}, level_name, kind, raw,
        epoch_sec * 1000000 + nanos // 1000 AS unix_us FROM parsed"""
    ),
    # The fields follow from the form; nothing is parsed.
    "line_forms": f"""WITH {PARTS}, forms AS (SELECT event_id, sec, event_id % 13 AS form FROM parts)
        SELECT event_id, CASE WHEN form IN (0, 1, 2, 3, 6) THEN 'raw' ELSE 'lager' END AS kind,
          CASE WHEN form NOT IN (0, 1, 2, 3, 6) THEN sec END AS epoch_sec,
          CASE WHEN form = 5 THEN 500000000 WHEN form NOT IN (0, 1, 2, 3, 6) THEN 250000000 END AS nanos,
          CASE WHEN form NOT IN (0, 1, 2, 3, 6) THEN 0 END AS log_level,
          CASE WHEN form NOT IN (0, 1, 2, 3, 6) THEN 's' END AS source,
          CASE form WHEN 4 THEN '' WHEN 5 THEN 'bare' WHEN 7 THEN 'last'
            WHEN 8 THEN 'tab' || chr(9) || ' quote" é' WHEN 9 THEN 'zürich 日本'
            WHEN 10 THEN 'carriage return' WHEN 11 THEN '' WHEN 12 THEN '' END AS message,
          NULL::VARCHAR AS session, NULL::VARCHAR AS error, NULL::VARCHAR AS trace,
          CASE form WHEN 4 THEN '{{"n":1}}' WHEN 9 THEN '{{"ключ":"значение"}}'
            WHEN 12 THEN '{{"n":' || repeat('[', 1200) || repeat(']', 1200) || '}}' END AS data
        FROM forms""",
    # An array or object of depth d around data and entry; lengths follow from the depth.
    "nested_lines": f"""WITH {PARTS}, depths AS (
          SELECT event_id, sec, event_id % 3 = 0 AS objects, CASE WHEN event_id % 20 = 1 THEN 3000 ELSE 1 END AS marks,
            CASE WHEN event_id % 20 = 0 THEN [3, 498, 499, 1200, 5000, 9998, 11000][event_id // 20 % 7 + 1]
              ELSE event_id % 4 END AS d FROM parts),
        sized AS (
          SELECT *, 6 + CASE WHEN d = 0 THEN 1 WHEN objects THEN 6 * d + 1 ELSE 2 * d END AS data_size FROM depths)
        SELECT event_id, CASE WHEN d > 9998 THEN 'too_deep' ELSE 'lager' END AS kind,
          CASE WHEN d <= 9998 THEN 1 + 2 * marks END AS message_length,
          CASE WHEN d <= 9998 THEN data_size END AS data_length,
          CASE WHEN d > 9998 THEN 54 + length(CAST(sec AS VARCHAR)) + 2 * marks + data_size END AS raw_length
        FROM sized""",
    "parse_kinds": over_parsed(
        "SELECT node AS file, kind, count(*) AS lines FROM parsed GROUP BY ALL"
    ),
    "strict_entries": where_entries("TRUE"),
    "raw_lines": over_parsed("SELECT node AS file, raw FROM parsed WHERE kind = 'raw'"),
    "json_candidates": over_lines(
        """SELECT node AS file, count(*) FILTER (value LIKE '{%') AS candidates,
        count(*) AS lines FROM lines GROUP BY node"""
    ),
    "any_case_keys": _any_case(),
    "object_error_dropped": over_entries(
        "SELECT node AS file, source, error, data FROM entries", value=OBJECT_ERROR
    ),
    # The text of a kept object comes out with sorted keys: cents, error, props.
    "object_error_kept": over_entries(
        """SELECT node AS file, source, error,
        CASE WHEN contains(data, '"error"') THEN regexp_replace(data,
          '^\\{"error":\\{"code":7\\},("cents":-?[0-9]+),', '{\\1,"error":{"code":7},')
        ELSE data END AS data FROM entries""",
        value=OBJECT_ERROR,
        keep_error=True,
    ),
    "top_level_fields": over_entries(
        "SELECT node AS file, source, session, error, trace, data FROM entries", value=TOP_FIELDS
    ),
    "epoch_timestamps": over_parts(
        f"""SELECT event_id, stamp, {SECONDS.format(t="stamp")} AS epoch_sec,
        {NANOS.format(t="stamp", s="(" + SECONDS.format(t="stamp") + ")")} AS nanos
        FROM (SELECT event_id, CASE WHEN event_id % 5 = 0
            THEN substr(sec || '999', 1, event_id % 13 + 1)
          WHEN event_id % 5 = 1 THEN '0' || sec
          ELSE sec || '.' || substr(frac || '123456', 1, event_id % 12) END AS stamp FROM parts)"""
    ),
    "rfc3339_timestamps": over_parts(
        """SELECT event_id,
          CASE event_id % 6 WHEN 0 THEN c || 'Z' WHEN 1 THEN c || '.' || frac || '789+02:00'
            WHEN 2 THEN c || '.' || left(frac, 2) || '-05:30'
            WHEN 3 THEN '2024-02-30' || c[11:19] || 'Z' WHEN 4 THEN c ELSE rfc END AS stamp,
          CASE event_id % 6 WHEN 0 THEN sec WHEN 1 THEN sec - 7200 WHEN 2 THEN sec + 19800
            WHEN 5 THEN sec END AS epoch_sec,
          CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN CAST(frac || '789' AS INTEGER)
            WHEN 2 THEN CAST(left(frac, 2) || '0000000' AS INTEGER)
            WHEN 5 THEN CAST(frac || '000' AS INTEGER) END AS nanos
        FROM (SELECT *, replace(clock, ' ', 'T') AS c FROM parts)"""
    ),
    "level_values": f"""WITH s AS (SELECT ['0', '1', '2', '3', '4', 'debug', 'info', 'error', 'fatal', 'INFO', ''] AS shapes),
      t AS (SELECT event_id, shapes[event_id % 11 + 1] AS a, shapes[user_id % 11 + 1] AS b FROM events, s),
      d AS (SELECT event_id, {LEVEL.format(t="a")} AS v1, {LEVEL.format(t="b")} AS v2 FROM t),
      m AS (SELECT *, greatest(coalesce(v1, 0), coalesce(v2, 0)) AS log_level FROM d)
      SELECT *, ['debug', 'info', 'error', 'fatal'][log_level + 1] AS level_name,
        upper(['debug', 'info', 'error', 'fatal'][log_level + 1]) AS level_label,
        coalesce(['debug', 'info', 'error', 'fatal'][log_level + event_id % 3 + 1], 'invalid') AS shifted_name
      FROM m""",
    "indented_data": over_entries("SELECT node AS file, data, 6 AS data_lines FROM entries"),
    "strip_color": over_lines(f"SELECT node AS file, {NO_COLOR.format(v='value')} AS value FROM lines"),
    "strip_ansi": over_lines(
        f"""SELECT node AS file, {NO_ANSI.format(v='w')} AS no_ansi, {NO_COLOR.format(v='w')} AS no_color
        FROM (SELECT node, chr(27) || 'P1;2q' || value || chr(27) || 'D~' AS w FROM lines)"""
    ),
    "strip_document_lines": f"WITH {DOC_LINES} SELECT doc_id, "
    + NO_COLOR.format(
        v="(replace(value, ' ', ' ' || chr(27) || '[01;31m' || chr(27) || '[K') || chr(27) || '[m' || chr(27) || '[K')"
    )
    + " AS value FROM doc_lines",
    "stripped_entries": over_entries(
        f"SELECT node AS file, {FIELD_LIST} FROM entries", value=NO_COLOR.format(v="value")
    ),
    "display_time": over_entries(
        f"""SELECT epoch_sec, nanos, {DISPLAY.format(t=UTC)} AS display,
        {DISPLAY.format(t=LOCAL)} AS display_local, {RFC} || 'Z' AS rfc3339,
        strftime({LOCAL}, '%Y-%m-%dT%H:%M:%S') || {FRACTION} || '+05:30' AS rfc3339_local FROM entries"""
    ),
    "padded_columns": over_entries(
        f"""SELECT {PAD.format(v="source", n=16)} AS source, {PAD.format(v="upper(level_name)", n=7)} AS level,
        {PAD.format(v="session", n=10)} AS session, {PAD.format(v="message", n=4)} AS message FROM entries"""
    ),
    "indent_document": """SELECT doc_id, repeat(' ', 27) ||
        replace(text, chr(10), chr(10) || repeat(' ', 27)) || chr(10) AS block FROM documents""",
    "component_color": _colors(),
    "log_type": over_parsed(
        r"""SELECT raw, CASE
          WHEN regexp_matches(raw, '^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[\w+\] \d+#\d:') THEN 'nginx_error'
          WHEN regexp_matches(raw, '^[-_.a-zA-Z0-9]* - \[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}[+ 0-9]*\]') THEN 'nginx_access'
          WHEN regexp_matches(raw, '^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} [[:print:]]+') THEN 'go_std'
          ELSE 'unknown' END AS log_type FROM parsed WHERE kind = 'raw'"""
    ),
    "time_range": where_entries(f"{AFTER_START} AND {BEFORE_END}"),
    "time_range_open": where_entries(
        "(epoch_sec > 1704844800 OR (epoch_sec = 1704844800 AND nanos > 0)) AND "
        "(epoch_sec < 1705753800 OR (epoch_sec = 1705753800 AND nanos < 1))"
    ),
    "time_after_epoch": where_entries(
        "epoch_sec > 1705000000 OR (epoch_sec = 1705000000 AND nanos >= 500000000)"
    ),
    "time_bound_texts": where_entries(
        "(epoch_sec > 1704866400 OR (epoch_sec = 1704866400 AND nanos >= 500000000))"
        " AND (epoch_sec < 1705104000 OR (epoch_sec = 1705104000 AND nanos <= 0))"
    ),
    "min_level": where_entries("log_level >= 2"),
    "level_set": where_entries("log_level IN (1, 3)"),
    "line_min_level": over_lines(
        """SELECT node AS file, value FROM lines
        WHERE regexp_matches(value, 'level":\\s*([23]|"(error|fatal)")')"""
    ),
    "pattern_literal": over_lines(
        "SELECT node AS file, value FROM lines WHERE contains(value, 'user-7')"
    ),
    "pattern_regex": over_lines(
        """SELECT node AS file, value FROM lines
        WHERE regexp_matches(value, '^[[:digit:]]{4}/01/(?P<day>1[0-9]) .*user-[0-9]+$')"""
    ),
    "pattern_set": where_entries(
        "contains(source, 'purchase') OR regexp_matches(source, '^sign.*:[02]$')"
    ),
    "document_patterns": f"""WITH {DOC_LINES} SELECT doc_id, value FROM doc_lines
        WHERE contains(value, 'the the') OR regexp_matches(value, '[0-9]{{3}}-[0-9]{{4}}')""",
    # A literal is a number in base 26 here; the first and last word are not between blanks.
    "literal_list": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
        SELECT doc_id, value FROM l WHERE len(list_filter(string_split(value, ' ')[2:-2], lambda w:
          regexp_full_match(w, '[a-z]{4}') AND
          ((((ascii(w[1]) - 97) * 26 + ascii(w[2]) - 97) * 26 + ascii(w[3]) - 97) * 26 + ascii(w[4]) - 97) % 45 = 0)) > 0""",
    "page_patterns": """SELECT page_id, contains(html, '<nav>') AS has_nav,
        regexp_matches(html, '<h[1-3][ >]') AS has_heading FROM pages""",
    "conversation_patterns": """SELECT conv_id, turn, role FROM conversations
        WHERE contains(text, 'then') OR contains(text, 'und')""",
    "composite_filter": where_entries(
        f"{AFTER_START} AND {BEFORE_END} AND log_level >= 1 AND (contains(source, 'signup:1') OR "
        "coalesce(contains(error, 'boom'), FALSE) OR regexp_matches(data, '\"k\":9.'))"
    ),
    "composite_bounds_only": where_entries(
        "(epoch_sec < 1704844800 OR (epoch_sec = 1704844800 AND nanos = 0)) AND log_level >= 1"
    ),
    "line_filter": over_lines(
        """SELECT node AS file, value FROM lines
        WHERE contains(value, 'signup:1') OR regexp_matches(value, 'bo+m')"""
    ),
    "contains_ignore_case": "SELECT doc_id, lang FROM documents WHERE contains(upper(text), 'THE AND')",
    "gate_counts": f"""WITH {parsed()}, {GATE} SELECT unit AS file, usable_lines, bad_lines,
        bad_lines < 100 AND usable_lines > 0 AS kept FROM counts""",
    "file_gate": f"WITH {parsed()}, {GATE}, gated AS ({GATED}) SELECT unit AS file, {FIELD_LIST} FROM gated",
    "gate_boundary": """WITH b AS (SELECT event_id // 1000 AS block, event_id % 1000 AS nth FROM events)
        SELECT 'bad-' || block || '.log' AS file,
          count(*) FILTER (nth >= 99 + block % 2) AS entries
        FROM b GROUP BY block
        HAVING count(*) FILTER (nth < 99 + block % 2) < 100
          AND count(*) FILTER (nth >= 99 + block % 2) > 0""",
    "file_report": f"WITH {parsed()}, {REPORT} SELECT * FROM report",
    "mixed_file_ratios": f"""WITH {parsed()}, {REPORT} SELECT *, total_lines - error_lines AS parsed_lines,
        CAST(round(error_lines * 10000.0 / total_lines) AS BIGINT) AS error_hundredths
        FROM report WHERE error_lines > 0 AND valid_lines > 0""",
    "line_counts": f"""WITH {DOC_LINES} SELECT lang, count(*) FILTER (length(value) > 0) AS lines
        FROM doc_lines GROUP BY lang""",
    "all_line_counts": f"WITH {DOC_LINES} SELECT lang, count(*) AS lines FROM doc_lines GROUP BY lang",
    "candidate_line_counts": over_lines(
        """SELECT node AS file, count(*) FILTER (regexp_matches(value,
        'level":\\s*(?:[123]|"(info|error|fatal)")')) AS lines FROM lines GROUP BY node"""
    ),
    "merge": over_entries(
        f"""SELECT node AS file, {FIELD_LIST} FROM entries
        UNION ALL SELECT unit AS file, {FIELD_LIST} FROM entries"""
    ),
    "same_entry": over_parts(
        "SELECT event_id, event_id % 5 <> 0 OR lvl = 3 AS same FROM parts"
    ),
    "unique_entries": over_entries(UNIQUE),
    "time_sorted": where_entries("TRUE"),
    "combined_report": f"""WITH {parsed()}, {GATE}, gated AS ({GATED})
        SELECT DISTINCT {FIELD_LIST}, level_name FROM gated WHERE log_level >= 1""",
    "json_lines": over_entries(f"SELECT {JSON_LINE} AS line FROM entries"),
    "json_round_trip": ENTRY_FIELDS,
    "pretty_color": over_entries(f"SELECT {_pretty(True)} AS text FROM entries"),
    "pretty_plain": over_entries(f"SELECT {_pretty(False)} AS text FROM entries"),
    "pretty_written": over_entries(
        f"""SELECT value FROM (SELECT unnest(string_split({_pretty(False)}, chr(10))) AS value
        FROM entries) WHERE length(value) > 0"""
    ),
    "stripped_rewrite": over_lines(f"SELECT {NO_COLOR.format(v='value')} AS value FROM lines"),
    "text_files": ALL_LINES,
    "text_files_stripped": over_lines(f"SELECT {NO_COLOR.format(v='value')} AS value FROM lines"),
    "gzip_and_bzip2_files": over_lines(
        "SELECT value FROM lines UNION ALL SELECT value FROM lines"
    ),
    "document_files": f"""WITH {DOC_LINES},
        -- a newline at the very end of a document starts no further line in a file,
        -- and an empty document still is one empty line
        written AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
        SELECT value, count(*) AS lines FROM written GROUP BY value""",
    "xz_files": ALL_LINES,
    "tar_archives": over_lines(
        "SELECT value FROM lines UNION ALL SELECT value FROM lines UNION ALL SELECT value FROM lines"
    ),
    "default_log_names": over_lines("SELECT value FROM lines UNION ALL SELECT value FROM lines"),
    "selected_files": over_lines(
        """SELECT value FROM lines
        WHERE node NOT IN ('node-1.log', 'node-2.log', 'node-3.log', 'node-7.log')"""
    ),
    "file_name_globs": over_lines(
        """SELECT node AS file, value FROM lines
        WHERE node IN ('node-0.log', 'node-1.log', 'node-2.log', 'node-9.log')"""
    ),
    "damaged_files_dropped": ALL_LINES,
    "combine_tree": f"""WITH {parsed()}, {BLOCKS}, gated AS ({BLOCKS_GATED})
        SELECT DISTINCT {FIELD_LIST}, level_name FROM gated""",
    "overlapping_roots": f"""WITH {parsed()}, {BLOCKS}, gated AS ({BLOCKS_GATED})
        SELECT {FIELD_LIST} FROM gated, generate_series(1, 2)""",
    "dropped_files": f"""WITH {parsed()}, {BLOCKS}
        SELECT unit AS file, usable_lines, bad_lines, FALSE AS failed,
          bad_lines < 100 AND usable_lines > 0 AS kept FROM counts
        UNION ALL SELECT 'damaged', 0, 0, TRUE, FALSE""",
    "repeated_members": over_lines("SELECT 'logs/app.log' AS member, value FROM lines"),
    "hidden_below_wildcards": over_lines("SELECT value FROM lines, generate_series(1, 3)"),
    "hidden_paths": over_lines("SELECT value FROM lines, generate_series(1, 2)"),
    "single_file_stripped": over_entries(
        f"SELECT {FIELD_LIST} FROM entries", value=NO_COLOR.format(v="value")
    ),
    "stream_filtered": over_entries(f"SELECT {FIELD_LIST} FROM entries WHERE log_level >= 1"),
    "stream_unique": over_entries(f"SELECT DISTINCT {FIELD_LIST} FROM entries"),
    "stream_sorted_batches": ENTRY_FIELDS,
    "stream_json_lines": over_entries(f"SELECT {JSON_LINE} AS line FROM entries"),
}
ORACLES["file_gate_shuffled"] = ORACLES["file_gate"]
ORACLES["report_listing"] = ORACLES["file_report"]
