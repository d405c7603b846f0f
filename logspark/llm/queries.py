"""One registered query for each operator of this folder, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.chat import chat_digests, format_chats
from logspark.llm.decontamination import find_contamination
from logspark.llm.language import identify_languages
from logspark.llm.line_dedup import deduplicate_lines
from logspark.llm.manifest import folded, leaf, manifest, siblings
from logspark.llm.mixing import mix
from logspark.llm.nearest import nearest_neighbours
from logspark.llm.negatives import hard_negatives
from logspark.llm.packing import pack
from logspark.llm.simhash import hex_fingerprint, near_duplicates
from logspark.llm.suffix_dedup import remove_repeats
from logspark.llm.tables import table
from logspark.llm.url_cascade import judge_urls
from logspark.llm.warc import page_records, read_archives, write_archives
from logspark.session import scratch_path

# A conversation whose texts hold the template's own marks.
MARKED_CHAT = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as token ids, and what reads back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(MARKED_CHAT, "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(turns.union(extra)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        hex_fingerprint("fp").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that repeat."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 6).alias("share"), "kind"
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after repeated runs of three lines went, as in the SQL."""
    return _kept_lines(deduplicate_lines(table(spark, sf_dir, "documents"), words=None))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with runs of fewer lines that have enough words."""
    return _kept_lines(deduplicate_lines(table(spark, sf_dir, "documents")))


def _kept_lines(kept: DataFrame) -> DataFrame:
    return kept.select(
        "doc_id",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.withColumnRenamed("id", "page_id")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return page_records(read_archives(spark, path, data=False))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of at most 4096 tokens."""
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"),
        "ids_crc32", "sequence_id", "offset",
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a copy tampered with is found out."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proved = manifest(table(spark, sf_dir, "documents"), leaf(*values), given=leaf(*values[:3], tampered, values[4]))
    rows = proved.withColumn("folded_root", folded("given"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)


QUERIES = {
    "op1_chat": op1_chat,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_suffixes": op4_suffixes,
    "op5_decontamination": op5_decontamination,
    "op6_mix": op6_mix,
    "op7_lines": op7_lines,
    "op7_passages": op7_passages,
    "op8_neighbours": op8_neighbours,
    "op9_urls": op9_urls,
    "op10_warc": op10_warc,
    "op11_packing": op11_packing,
    "op12_manifest": op12_manifest,
    "op13_negatives": op13_negatives,
}

ORACLES = {
    "op13_negatives": """
WITH given AS (
  SELECT row_number() OVER () AS u, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT * FROM given WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.u AS a, a.vec_id AS anchor_id, g.u, g.vec_id, a.label = g.label AS same,
         CAST(list_dot_product(a.v, g.v) AS BIGINT) AS score
  FROM anchors a JOIN given g ON a.u <> g.u),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p FROM scored WHERE same QUALIFY p <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id,
         CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
         n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT * FROM negatives WHERE rank <= 3
""",
    "op12_manifest": r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
                                  xor(crc, byte)),
    4294967295) AS crc
  FROM documents),
fields AS (
  SELECT d.*, row_number() OVER () AS u, coalesce(xor(b.crc, 4294967295) % 7 = 0, false) AS changed
  FROM documents d LEFT JOIN (SELECT DISTINCT * FROM bits) b ON d.doc_id = b.doc_id),
parts AS (
  SELECT *,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    CASE WHEN changed THEN n_chars + 1 ELSE n_chars END AS n_changed,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM fields),
leaves AS (
  SELECT u, doc_id, lang,
    sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(length(CAST(n_changed AS VARCHAR)) || ':' || n_changed, '-') || tail) AS given
  FROM parts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, nth, leaf AS digest, n FROM placed
  UNION ALL
  SELECT lang, level + 1, nth // 2, sha256(string_agg(digest, '' ORDER BY nth)), (any_value(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, nth // 2),
subroots AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, nth, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, nth // 2, sha256(string_agg(digest, '' ORDER BY nth)), (any_value(n) + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, nth // 2),
root AS (SELECT digest AS root, level AS height FROM tops WHERE n = 1),
steps AS (
  SELECT p.u, l.level, (p.nth >> l.level) % 2 AS side, s.digest AS sibling
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
  JOIN (SELECT DISTINCT level FROM nodes) l ON l.level < r.height
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.nth = xor(p.nth >> l.level, 1)
  UNION ALL
  SELECT p.u, r.height + l.level, (r.nth >> l.level) % 2, s.digest
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
  JOIN (SELECT DISTINCT level FROM tops) l ON l.level < (SELECT height FROM root)
  LEFT JOIN tops s ON s.level = l.level AND s.nth = xor(r.nth >> l.level, 1)),
proofs AS (
  SELECT u, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, max(level) + 1 AS height
  FROM steps GROUP BY u),
fold AS (
  SELECT u, 0 AS level, given AS digest FROM placed
  UNION ALL
  SELECT f.u, f.level + 1, sha256(CASE WHEN s.side = 1 THEN coalesce(s.sibling, '') || f.digest
                                       ELSE f.digest || coalesce(s.sibling, '') END)
  FROM fold f JOIN steps s ON s.u = f.u AND s.level = f.level),
ends AS (SELECT u, arg_max(digest, level) AS folded_root FROM fold GROUP BY u)
SELECT p.doc_id, p.leaf, r.subroot, t.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = t.root AS verified
FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root t
JOIN ends e ON e.u = p.u LEFT JOIN proofs q ON q.u = p.u
""",
    "op6_mix": r"""
WITH sized AS (
  SELECT doc_id, source, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * words / weight, source NULLS LAST) AS r FROM sources),
sums AS (
  SELECT *, sum(words) OVER () AS total,
         coalesce(sum(2 * words) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM ordered),
level AS (
  SELECT *, (1.5::DOUBLE * total - capped) AS remain FROM sums),
first AS (
  SELECT min(r) AS r FROM level WHERE remain * weight / open::DOUBLE <= 2 * words),
filled AS (
  SELECT l.source, l.words,
         CASE WHEN l.r < f.r THEN (2 * l.words)::DOUBLE
              ELSE e.remain * l.weight::DOUBLE / e.open::DOUBLE END AS target
  FROM level l, first f JOIN level e ON e.r = f.r),
plan AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target) AS BIGINT) // words ELSE 0 END AS whole FROM filled),
ranked AS (
  SELECT s.*, p.words AS source_size, p.target, p.whole,
         CASE WHEN p.words > 0 THEN CAST(floor(p.target) AS BIGINT) - p.whole * p.words ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM ranked
""",
    "op1_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, '[INST]' || regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')
            || '[/INST]' || regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')
            || '</s>' AS formatted
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op9_urls": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
    "op7_lines": """
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
w AS (
  SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS w
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM w WHERE w IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM f, (VALUES (0), (1), (2)) t(k) WHERE r > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id),
whole AS (
  SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
  FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id)
SELECT doc_id, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM whole
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
""",
}
