"""Removal of repeated byte strings by prefix doubling on chosen suffixes.

A string of ``LENGTH`` bytes counts as repeated if it also starts anywhere else. Ranking
the suffixes at all positions would sort several times 16 bytes for every byte of text, so
only some suffixes are ranked: each string of ``LENGTH`` bytes is held by the one of its
``CORE``-byte windows with the least hash (the first of equals). Equal strings choose the
same window, so only strings held by windows with equal rank need be told apart. One
window holds a run of neighbouring strings.

Ranks start with the windows themselves and are refined at growing lengths. In each round
Spark brings pairs of a rank and the bytes that follow it (on both sides) together and
gives equal pairs one new rank. The longer core is what ever fewer neighbouring strings
have in common: 58 bytes for 343 strings, then 352 for 49, 394 for 7 and 400 for one. A
suffix whose rank is unique leaves; runs of strings whose whole extent is repeated are
settled at once, and one of them stays as a partner for others. So rounds see only the
ends of repeated passages. No pair of positions is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import Steps, staged
from logspark.session import ship_package

LENGTH = 400
# Strings held by one window are told apart in rounds that cut runs into this many parts.
FAN_OUT = 7
ROUNDS = 3
STRINGS = FAN_OUT**ROUNDS
CORE = LENGTH - STRINGS + 1
# Starts examined at once; bounds the memory for a long text.
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number for each byte."""
    n = _SEGMENT + LENGTH
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return up, down, np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


def _holders(part: np.ndarray) -> np.ndarray:
    """For each start of a whole string the offset of the window that holds it."""
    up, down, values = _powers()
    n = len(part)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * up[:n], out=sums[1:])
        hashes = (sums[CORE:] - sums[:-CORE]) * down[: n - CORE + 1]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    # Offsets in the low half make the first of equal hashes the least.
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    count = len(keys) - STRINGS + 1
    rows = -(-len(keys) // STRINGS)
    padded = np.full(rows * STRINGS, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, STRINGS)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:count], ahead[STRINGS - 1 : STRINGS - 1 + count])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of_strings(text: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """First and last start, window, and keys of the window and the whole extent of each run."""
    view, whole = memoryview(text), np.frombuffer(text, np.uint8)
    for begin in range(0, len(text) - LENGTH + 1, _SEGMENT):
        held = _holders(whole[begin : begin + _SEGMENT + LENGTH - 1]) + begin
        first = np.flatnonzero(np.diff(held, prepend=-1))
        last = np.append(first[1:], len(held)) - 1
        for p, q, a in zip((first + begin).tolist(), (last + begin).tolist(), held[first].tolist()):
            extent = xxhash.xxh3_128_digest(view[p : q + LENGTH], (a - p) << 32 | (a - q))
            yield p, q, a, xxhash.xxh3_64_intdigest(view[a : a + CORE]) - (1 << 63), extent


_RUN = pa.schema(
    [
        ("doc", pa.binary()),
        ("p", pa.int64()),
        ("q", pa.int64()),
        ("a", pa.int64()),
        ("core", pa.int64()),
        ("extent", pa.binary()),
    ]
)


def _runs(texts: DataFrame) -> DataFrame:
    """All runs of the texts (``doc``, ``text``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                for run in runs_of_strings(text):
                    found.append(run)
                    owners.append(doc)
                    if len(found) == 50_000:
                        yield _batch(owners, found)
                        found, owners = [], []
            if found:
                yield _batch(owners, found)

    long_enough = texts.where(F.octet_length("text") >= LENGTH)
    return long_enough.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, "doc binary, p long, q long, a long, core long, extent binary"
    )


def _batch(owners: list, found: list) -> pa.RecordBatch:
    columns = [owners, *zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _RUN)], schema=_RUN)


def _reranked(rows: DataFrame, core: list[str], extent: list[str], steps: Steps, name: str) -> DataFrame:
    """``rows`` that are settled or go on, with ``n``, ``goes_on``, ``chosen`` and ``rank``.

    Rows equal in ``core`` get one rank, named after the least of them. ``n`` counts rows
    whose extent is equal too, ``goes_on`` tells if a rank has several extents and rows not
    settled, and ``chosen`` marks one row of each extent.
    """
    place = F.xxhash64("doc", "p")
    extents = rows.groupBy(*core, *extent).agg(
        F.count("*").alias("n"), F.max("done").alias("was_done"), F.min(place).alias("one")
    )
    extents = steps.write(extents, f"{name}-extents")
    cores = extents.groupBy(*core).agg(
        F.count("*").alias("c"),
        F.max((F.col("n") == 1) & ~F.col("was_done")).alias("open"),
        F.min("one").alias("rank"),
    )
    cores = steps.write(cores.where("c > 1 and open").select(*core, "rank"), f"{name}-ranks")
    named = extents.join(cores, core, "left").where("n > 1 or rank is not null")
    named = named.select(*core, *extent, "n", "one", "rank")
    named = steps.write(named, f"{name}-named", [f"{name}-extents", f"{name}-ranks"])
    joined = rows.drop("rank").join(named, [*core, *extent])
    return (
        joined.withColumn("chosen", F.col("one") == place)
        .withColumn("goes_on", F.col("rank").isNotNull())
        .drop(*core[1:], *extent, "one")
    )


def _settled(marked: DataFrame, first: str, last: str) -> DataFrame:
    return marked.where("n > 1 and not done").select("doc", F.expr(first).alias("first"), F.expr(last).alias("last"))


def _going_on(marked: DataFrame) -> DataFrame:
    return marked.where("chosen and goes_on").select(
        "doc", "p", "a", "lo", "hi", "x", "y", "rank", (F.col("done") | (F.col("n") > 1)).alias("done")
    )


def repeated_starts(texts: DataFrame, steps: Steps) -> DataFrame:
    """Starts of repeated strings, as ranges ``first`` to ``last`` for each ``doc``.

    ``texts`` has ``doc`` (binary, equal for equal texts), ``id`` (of any ordered type,
    smallest of a text is used to read it again) and ``text``.
    """
    runs = steps.write(_runs(texts.select("doc", "text")), "runs")
    twice = runs.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    twice = steps.write(twice, "cores")
    rows = runs.join(twice, "core", "left_semi").select(
        "doc",
        "p",
        "a",
        "core",
        "extent",
        (F.col("a") - F.col("q")).cast("int").alias("lo"),
        (F.col("a") - F.col("p")).cast("int").alias("hi"),
        F.lit(0).alias("x"),
        F.lit(STRINGS - 1).alias("y"),
        F.lit(False).alias("done"),
    )
    rows = steps.write(rows, "candidates", ["runs", "cores"])
    marked = steps.write(_reranked(rows, ["core"], ["extent"], steps, "first"), "marked", ["candidates", "first-named"])
    found = [_settled(marked, "a - hi", "a - lo")]
    # Documents of one text have the same runs, so only one of each goes on.
    going = _going_on(marked).distinct()
    # The bytes that the strings of these runs cover together. Texts that several rows of
    # one id share come more than once; all their strings are settled already.
    wanted = going.groupBy("doc").agg(
        F.collect_list(F.struct("p", "a", "lo", "hi", "x", "y", "rank", "done")).alias("parts")
    )
    least = texts.groupBy("doc").agg(F.min("id").alias("least"))
    wanted = steps.write(wanted.join(least, "doc").withColumnRenamed("doc", "d"), "wanted")
    read = texts.join(wanted, (F.col("doc") == F.col("d")) & F.col("id").eqNullSafe(F.col("least")))
    parts = read.select("doc", F.col("text").cast("binary").alias("text"), F.explode("parts").alias("part"))
    length = F.col("part.hi") - F.col("part.lo") + LENGTH
    bytes_of = F.substring("text", (F.col("part.p") + 1).cast("int"), length)
    going = steps.write(parts.select("doc", "part.*", bytes_of.alias("bytes")), "going-0", ["wanted"])
    for number in range(1, ROUNDS + 1):
        width = STRINGS // FAN_OUT**number
        rows = steps.write(_longer(going, width), f"longer-{number}")
        again = steps.write(
            _reranked(rows, ["x", "k1", "k2"], ["e1", "e2"], steps, f"round-{number}"),
            f"marked-{number}",
            [f"longer-{number}", f"round-{number}-named"],
        )
        cx, cy = "greatest(x, lo)", f"least(x + {width - 1}, hi)"
        found.append(_settled(again, f"a - {cy}", f"a - {cx}"))
        if number < ROUNDS:
            # Parts of one run that went on before hold the same bytes.
            texts_of = going.select("doc", "p", "bytes")
            texts_of = texts_of.dropDuplicates(["doc", "p"]) if number > 1 else texts_of
            going = _going_on(again).join(texts_of, ["doc", "p"])
            going = steps.write(going, f"going-{number}", [f"going-{number - 1}"])
    return reduce(DataFrame.union, found)


def _longer(rows: DataFrame, width: int) -> DataFrame:
    """Runs cut into parts of ``width`` strings, with keys of their longer core and of their extent.

    Strings of a run start ``lo`` to ``hi`` bytes before its window, those of a part ``x``
    to ``y``; ``bytes`` begins with the first string. The key of a core pairs the rank of
    the shorter core with the bytes on both sides by which it is longer.
    """
    start = F.explode(F.sequence(F.col("x"), F.col("y"), F.lit(width)))
    each = rows.select(
        "doc", "p", "a", "lo", "hi", "rank", "done", "bytes",
        F.col("x").alias("px"), F.col("y").alias("py"), start.alias("x"),
    )
    each = each.withColumn("y", F.col("x") + width - 1).where("x <= hi and y >= lo")
    cx, cy = F.greatest("x", "lo"), F.least("y", "hi")
    extent = F.substring("bytes", F.col("hi") - cy + 1, cy - cx + LENGTH)
    before = F.substring("bytes", F.col("hi") - F.col("x") + 1, F.col("x") - F.col("px"))
    after = F.substring("bytes", F.col("hi") - F.col("py") + LENGTH + 1, F.col("py") - F.col("y"))
    # Two 64-bit hashes each; chance matches of both are out of the question at any size.
    pair, whole = (F.col("rank"), before, after), (cx, cy, extent)
    return each.select(
        "doc", "p", "a", "lo", "hi", "x", "y", "done",
        F.xxhash64(*pair).alias("k1"),
        F.xxhash64(F.lit(1), *pair).alias("k2"),
        F.xxhash64(*whole).alias("e1"),
        F.xxhash64(F.lit(1), *whole).alias("e2"),
    )


def _spans(first: list, last: list) -> list[dict]:
    """Maximal covered byte ranges of repeated starts."""
    spans: list[dict] = []
    for p, q in sorted(zip(first, last)):
        if spans and p <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], q + LENGTH)
        else:
            spans.append({"start": p, "end": q + LENGTH})
    return spans


def remove_repeats(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``spans`` and ``kept`` (binary).

    Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in
    this or another document, is removed; what repeats is judged on the texts as given.
    ``spans`` are the maximal removed ranges (``start``, ``end`` exclusive), ``kept`` the
    other bytes, which may part a character. NULL texts count as empty. Repeated rows are
    documents like others, so from ``LENGTH`` bytes on they lose everything. Other columns
    are ignored; no rows give no rows.
    """
    ship_package(documents.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    own = documents.select(F.col(id).alias("id"), content.alias("text"))
    own = own.withColumn("doc", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    steps = Steps(documents.sparkSession)
    found = repeated_starts(own.select("doc", "id", "text"), steps)

    @F.pandas_udf("array<struct<start long, end long>>")
    def merged(first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([_spans(p.tolist(), q.tolist()) for p, q in zip(first, last)])

    spans = (
        found.distinct()
        .groupBy("doc")
        .agg(F.collect_list("first").alias("f"), F.collect_list("last").alias("l"))
        .select(F.col("doc").alias("d"), merged("f", "l").alias("spans"))
    )

    spans = staged(spans, "spans")
    del found
    steps.drop(*list(steps.paths))
    joined = own.join(spans, F.col("doc") == F.col("d"), "left")
    return joined.select(
        "id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        _kept(F.col("text").cast("binary"), F.col("spans")).alias("kept"),
    )


def _kept(text: Column, spans: Column) -> Column:
    @F.pandas_udf("binary")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        kept = []
        for text, spans in zip(texts, all_spans):
            parts, at = [], 0
            for span in spans:
                parts.append(text[at : span["start"]])
                at = span["end"]
            kept.append(b"".join(parts) + text[at:])
        return pd.Series(kept)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return cut(text, F.coalesce(spans, none))
