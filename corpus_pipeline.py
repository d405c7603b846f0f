"""A corpus from documents: languages, repeated lines, near duplicates, benchmarks, mixing.

Each stage takes the rows its predecessor kept, as Parquet in the shared folder, and
returns them with the columns of ``documents``; the last adds what the mix takes. Texts
may be NULL or empty, ids NULL or repeated; further columns pass through. A row is known
by its id and a hash of its text. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.decontamination import find_contamination
from logspark.llm.language import UNKNOWN, fit, held_out, with_language
from logspark.llm.line_dedup import deduplicate_lines
from logspark.llm.mixing import mix
from logspark.llm.simhash import near_duplicates
from logspark.llm.tables import packed, staged, table


# Least posterior probability of the predicted language: it outweighs all others together.
SURE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts whose language is not told: NULL, without a letter, or with a score below ``SURE``.

    If no row has a language to learn from, all texts with a letter stay.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = with_language(packed(docs, F.col("text").alias("text")), model)
    told = (F.col("language.language") != UNKNOWN) & (F.col("language.score") >= SURE)
    return rows.where(told).select("row.*")


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without runs of lines that stand earlier in the corpus; every document stays."""
    return deduplicate_lines(docs)


def _row_key() -> list[Column]:
    """Id and hash of the text, never NULL."""
    return [
        F.col("doc_id").isNull().alias("k1"),
        F.coalesce("doc_id", F.lit(0)).alias("k2"),
        F.xxhash64("text").alias("k3"),
    ]


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the least id, once."""
    keys = docs.select(F.struct(*_row_key()).alias("key"), "text")
    groups = near_duplicates(keys, id="key")
    chosen = staged(groups.select("component.*").distinct(), "chosen")
    kept = packed(docs, *_row_key()).join(chosen, ["k1", "k2", "k3"], "left_semi")
    return kept.dropDuplicates(["k1", "k2", "k3"]).select("row.*")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item, copied or re-parameterised."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = staged(found.select("id", "digest").distinct(), "contaminated")
    rows = packed(docs, F.col("doc_id").alias("i"), F.xxhash64("text").alias("d"))
    return rows.join(bad, F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest")), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with ``size``, ``source_size``, ``target`` and ``taken``.

    A column of the documents that has such a name stays, and the mix's is called ``mix_size``
    and so on, with ``mix_`` as often as it takes.
    """
    def free(name: str) -> str:
        while name in docs.columns:
            name = f"mix_{name}"
        return name

    key = F.concat_ws(":", "doc_id", F.xxhash64("text")).alias("key")
    taken = mix(docs.select(key, "source", "text"), id="key").where("taken > 0")
    added = [F.col(c).alias(free(c)) for c in ("size", "source_size", "target", "taken")]
    once = staged(taken.select(F.col("id").alias("key"), F.struct(*added).alias("mix")), "taken")
    return packed(docs, key).join(once, "key").select("row.*", "mix.*")


STAGES = [
    ("language", known_language),
    ("lines", unrepeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

# Language scores and 64-bit shingle hashes have no SQL there; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
