"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the largest distance differ
in some segment by no more than its share of the bits, so every fingerprint looks up all
values of that small Hamming ball in the table of each segment; whole distances are then
verified. Documents with one fingerprint are one entry of the tables, so a group of
copies costs one row however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.components import connected_components
from logspark.llm.tables import staged
from logspark.session import ship_package

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEGMENTS = 2
# Shingle hashes whose bits are counted at once; bounds the memory of a long text.
_BLOCK = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a text as a signed 64-bit number; zero if it has no words.

    Only A-Z are lower-cased. Words are parted by ASCII white space. A text shorter than
    one shingle is one shingle. A bit is 1 if it is set in more than half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(words_per_shingle, len(words))
    total = len(words) - size + 1
    counts = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, total, _BLOCK):
        stop = min(start + _BLOCK, total)
        shingles = zip(*(words[start + i : stop + i] for i in range(size)))
        hashes = np.array([digest(join(s), SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the SimHash of column ``text`` as BIGINT column ``name``."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    ship_package(df.sparkSession)
    return df.withColumn(name, of(F.col(text)))


def hex_fingerprint(column: str):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def _ball(width: int, radius: int) -> list[int]:
    """All bit masks of a segment with at most ``radius`` bits."""
    picks = (c for r in range(radius + 1) for c in combinations(range(width), r))
    return [sum(1 << bit for bit in pick) for pick in picks]


def near_pairs(
    fingerprints: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """Pairs ``u``, ``v`` of different fingerprints that differ in few bits.

    ``fingerprints`` has one distinct BIGINT column ``fp``. A pair can come out once for
    each segment that finds it.
    """
    width = BITS // segments
    low = F.lit((1 << width) - 1)
    table = fingerprints.select(
        "fp",
        F.posexplode(
            F.array(*[F.shiftrightunsigned("fp", width * i).bitwiseAND(low) for i in range(segments)])
        ).alias("segment", "value"),
    )
    # Of two values in one ball the lesser looks up the greater.
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, max_distance // segments)])
    probes = (
        table.withColumn("mask", F.explode(masks))
        .withColumn("probe", F.col("value").bitwiseXOR(F.col("mask")))
        .where("probe >= value")
        .select(F.col("fp").alias("u"), "segment", F.col("probe").alias("value"), "mask")
    )
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= max_distance
    once = (F.col("mask") != 0) | (F.col("u") < F.col("fp"))
    joined = probes.join(
        table.withColumnRenamed("segment", "s").withColumnRenamed("value", "x"),
        (F.col("segment") == F.col("s")) & (F.col("value") == F.col("x")) & close & once,
    )
    return joined.select("u", F.col("fp").alias("v"))


def near_duplicates(
    documents: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component``.

    ``component`` is the least id among all documents that a chain of fingerprints within
    ``max_distance`` bits connects. NULL and wordless texts have fingerprint zero and link
    like others. Repeated rows come out as often as they go in. A NULL id counts as
    greater than all, so ``component`` is NULL only where all ids of a group are. ``id``
    may be of any ordered type. Other columns are ignored; no rows give no rows.
    """
    own = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    prints = staged(
        with_fingerprint(own, "text", "fp", words_per_shingle).select("id", "fp"), "fingerprints"
    )
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    parts = connected_components(near_pairs(nodes.select("fp"), max_distance, segments))
    rooted = nodes.join(parts, nodes.fp == parts.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    rooted = staged(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    # A written table on this side lets Spark split a hot fingerprint on the other.
    named = staged(rooted.join(least, "root").select("fp", "component"), "components")
    return prints.join(named, "fp").select("id", "fp", "component")
