"""Hard negatives by angular triangle filtering.

For every row the angles to a few reference directions are stored. By the triangle
inequality on the sphere, the angle between an anchor and a row lies between the largest
difference and the smallest sum of their angles to one reference. The cosines of these
limits times both norms, widened for rounding, bound the integer score. Only pairs whose
bounds overlap the window of scores that is asked for are scored, exactly.

Rows are sorted by label, nearest reference and angle to it, and cut into blocks of equal
size, so that a block holds similar rows. An anchor is sent only to the blocks whose bounds,
taken over all their rows, overlap its window. A task holds one block of rows; the anchors
sent to it stream past. Positives are first looked for in the anchor's own block, whose
scores are the lower limit for all other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.tables import numbered, staged
from logspark.session import ship_package

REFERENCES = 8
# Rows from which references are chosen.
SAMPLE = 2_000
# Least rows of a block; blocks grow so that there are never more than MAX_BLOCKS, which bounds
# what is known of them to some MB.
BLOCK_ROWS = 1_024
MAX_BLOCKS = 20_000
# Angles are this exact (arc cosines near 1 lose half the digits), scores this exact relatively.
_ANGLE_ERROR = 1e-6
_SCORE_ERROR = 1e-9
# Integers up to this are exact in double precision.
_EXACT = 2.0**52
# Components from here on count as infinite: their squares would be.
_LARGEST = 1e140
_LEAST, _MOST = -(2**63), 2**63 - 1
# Anchors handled at a time.
_STRIP = 512


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _directions(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors**2).sum(1))
    return vectors / np.where(norms > 0, norms, 1)[:, None]


def choose_references(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions of the centres of a few k-means rounds, begun far apart; any would be right."""
    rows = _directions(sample)
    rows = rows[(rows != 0).any(1)]
    if not len(rows):
        return np.eye(1, sample.shape[1])
    centres = rows[:1]
    while len(centres) < min(count, len(rows)):
        centres = np.vstack([centres, rows[np.argmin((rows @ centres.T).max(1))]])
    for _ in range(5):
        nearest = np.argmax(rows @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        moved = _directions(sums)
        centres = np.where((moved != 0).any(1)[:, None], moved, centres)
    return centres


def _described(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """``norm``, ``angles`` to the references, the nearest (``home``) and the angle to it (``away``)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("v"))
            norms = np.sqrt((vectors**2).sum(1))
            angles = np.arccos(np.clip(_directions(vectors) @ references.T, -1, 1))
            home = np.argmin(angles, 1)
            away = angles[np.arange(len(angles)), home]
            ends = np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1]
            columns = [pa.array(norms), pa.ListArray.from_arrays(ends, angles.ravel()), pa.array(home.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "norm", "angles", "home", "away"])

    return rows.mapInArrow(describe, f"{fields}, norm double, angles array<double>, home int, away double")


@dataclass
class _Rows:
    """Some rows or anchors as arrays."""

    n: np.ndarray  # a row's own number
    label: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> _Rows:
        n, label, norm = (batch.column(c).to_numpy() for c in ("n", "label", "norm"))
        v, angles = (batch.column(c) for c in ("v", "angles"))
        v, angles = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (v, angles))
        return cls(n, label, _vectors(v), norm, _vectors(angles))

    def __getitem__(self, at) -> _Rows:
        return _Rows(*(getattr(self, f)[at] for f in ("n", "label", "vectors", "norms", "angles")))


def score_limits(a: _Rows, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each anchor and row can have, by their stored angles alone."""
    shape = (len(a.n), len(rows.n))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for r in range(a.angles.shape[1]):
        s, t = a.angles[:, r, None], rows.angles[None, :, r]
        np.maximum(near, np.abs(s - t), out=near)
        total = s + t
        np.minimum(far, np.minimum(total, 2 * np.pi - total), out=far)
    norms = a.norms[:, None] * rows.norms[None, :]
    slack = norms * _SCORE_ERROR + 1
    least = norms * np.cos(np.minimum(far + 2 * _ANGLE_ERROR, np.pi)) - slack
    return least, norms * np.cos(np.maximum(near - 2 * _ANGLE_ERROR, 0)) + slack


def scores(a: _Rows, rows: _Rows, wanted: np.ndarray) -> np.ndarray:
    """Integer scores of the wanted pairs; :data:`_LEAST` elsewhere."""
    out = np.full(wanted.shape, _LEAST, np.int64)
    some, those = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    if not len(some):
        return out
    left, right, mask = a.vectors[some], rows.vectors[those], wanted[np.ix_(some, those)]
    if a.norms[some].max() * rows.norms[those].max() >= _EXACT:
        # Beyond double precision: whole numbers of any size, and the nearest long.
        at, to = np.nonzero(mask)
        left, right = ([[int(x) for x in v] for v in m] for m in (left, right))
        exact = (sum(x * y for x, y in zip(left[i], right[j], strict=True)) for i, j in zip(at, to, strict=True))
        out[some[at], those[to]] = [min(max(s, _LEAST + 1), _MOST) for s in exact]
    elif mask.mean() < 0.05:
        at, to = np.nonzero(mask)
        out[some[at], those[to]] = np.einsum("ij,ij->i", left[at], right[to]).astype(np.int64)
    else:
        out[np.ix_(some, those)] = np.where(mask, (left @ right.T).astype(np.int64), _LEAST)
    return out


def _first(found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of each anchor's ``k`` highest scores, ties by ``ids``."""
    if found.shape[1] > k:
        limit = np.maximum(np.partition(found, found.shape[1] - k, 1)[:, -k], _LEAST + 1)
    else:
        limit = np.full(len(found), _LEAST + 1)
    at, to = np.nonzero(found >= limit[:, None])
    order = np.lexsort((ids[to], -found[at, to], at))
    at, to = at[order], to[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], to[nth < k]


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores from ``low`` to ``high`` per cent of a positive's, as whole numbers."""
    return -(-low * positive // 100), high * positive // 100


def _sent(anchors: DataFrame, blocks: np.ndarray, refs: int, same_label: bool, own: bool | None) -> DataFrame:
    """Anchors once for every block that can hold rows of their windows, which have ``least``.

    ``blocks`` has rows (least label, largest label, largest norm, least angles, largest angles).
    ``own`` sends them to their own block alone (True) or to all others (False).
    """
    names, fields = anchors.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, norm = blocks[:, 0], blocks[:, 1], blocks[:, 2]
        low, high = blocks[:, 3 : 3 + refs], blocks[:, 3 + refs :]
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                a, home = _Rows.of(part), part.column("home_block").to_numpy()
                if own:
                    at, to = np.arange(len(home)), home
                else:
                    label = a.label[:, None]
                    wanted = (first <= label) & (label <= last) if same_label else ~((first == label) & (last == label))
                    near = np.zeros(wanted.shape)
                    for r in range(refs):
                        s = a.angles[:, r, None]
                        np.maximum(near, np.maximum(low[:, r] - s, s - high[:, r]), out=near)
                    most = a.norms[:, None] * norm
                    cosine = np.maximum(np.cos(np.maximum(near - 2 * _ANGLE_ERROR, 0)), 0)
                    limit = most * cosine + most * _SCORE_ERROR + 1
                    wanted &= limit >= part.column("least").to_numpy()[:, None]
                    if own is False:
                        wanted[np.arange(len(home)), home] = False
                    at, to = np.nonzero(wanted)
                if len(at):
                    columns = [c.take(pa.array(at)) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(to.astype(np.int64))], [*names, "block"])

    return anchors.mapInArrow(send, f"{fields}, block long")


def _meet(rows: DataFrame, sent: DataFrame, search, result: str) -> DataFrame:
    """Run ``search(rows of a block, their ids, some anchors, their batch)`` for all that were sent.

    One sorted stream: a block's rows, which stay in memory, and then its anchors.
    """
    kind = lambda k: F.lit(k).alias("kind")
    stream = (
        rows.select(kind(0), "*")
        .unionByName(sent.select(kind(1), "*"), allowMissingColumns=True)
        .repartition("block")
        .sortWithinPartitions("block", "kind", "n")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready, ids = None, [], None, None
        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    if numbers[begin] != block:
                        block, held, ready = numbers[begin], [], None
                    held.append(part)
                    continue
                if ready is None:
                    whole = pa.Table.from_batches(held)
                    ready, ids, held = _Rows.of(whole), whole.column("id").combine_chunks(), []
                for at in range(0, part.num_rows, _STRIP):
                    some = part.slice(at, _STRIP)
                    yield from search(ready, ids, _Rows.of(some), some)

    return stream.mapInArrow(meet, result)


_FOUND = "anchor long, window int, id long, score long"


def _rows_found(a: _Rows, ids: pa.Array, at: np.ndarray, to: np.ndarray, window: int, found: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.array(a.n[at]), pa.array(np.full(len(at), window, np.int32)), ids.take(pa.array(to)), pa.array(found[at, to])
    ]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "window", "id", "score"])


def _order(ids: pa.Array) -> np.ndarray:
    """Ids to sort by, NULL first."""
    return ids.fill_null(_LEAST).to_numpy(zero_copy_only=False)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest of all blocks, with ``rank`` from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    references: int = REFERENCES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all anchors.

    A component x counts as floor(scale * x), and a score is the integer inner product with
    the anchor; higher scores come first, ties by smaller id (NULL first). An anchor's
    positives are its first ``positives`` other rows of its label. For each, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the
    positive's are its hard negatives; if there are none, there is no row.

    ``anchors`` picks them among the rows. Rows whose label or vector is NULL, or that have a
    NULL or non-finite component, take no part, nor do rows of another length than most (of
    the shorter, if as many) or empty ones. Zero vectors score 0. Repeated rows count as often as they
    come. A score beyond a long counts as the nearest long. Other columns are ignored; empty
    tables give no rows. ``label`` and ``id`` are whole numbers.
    """
    spark = rows.sparkSession
    ship_package(spark)
    own = rows.select(
        F.col(id).cast("long").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
        F.col(vector).cast("array<double>").alias("x"),
    )
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST))
    own = own.where(F.col("label").isNotNull() & F.col("x").isNotNull() & usable)
    own = own.where(F.size("x") > 0)
    length = own.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    own = own.where(F.size("x") == (length["size"] if length else 0))
    # Doubles beyond 2**53 are whole numbers, and may be beyond a long.
    floor = F.transform("x", lambda x: F.when(F.abs(x * scale) < _EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    whole = own.select("id", "label", "asked", floor.alias("v"))
    sample = whole.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()
    chosen = choose_references(np.array([r.v for r in sample], float).reshape(len(sample), -1 if sample else 0), references)
    placed, starts = numbered(
        _described(whole, chosen).withColumn("all", F.lit(0)), "all", ["label", "home", "away"]
    )
    total = placed.count()
    size = max(block_rows, -(-total // MAX_BLOCKS))
    n = F.col("first") + F.col("nth")
    firsts = F.broadcast(starts.select("part", "first"))  # one row for each task that sorted
    placed = placed.join(firsts, "part").select(
        n.alias("n"), (n / size).cast("long").alias("block"), "id", "label", "asked", "v", "norm", "angles"
    )
    refs = len(chosen)
    limits = [F.min("label"), F.max("label"), F.max("norm")]
    limits += [f(F.element_at("angles", r + 1)) for f in (F.min, F.max) for r in range(refs)]
    known = placed.groupBy("block").agg(*[x.cast("double").alias(f"c{i}") for i, x in enumerate(limits)])
    # At most MAX_BLOCKS rows.
    blocks = np.array([r[1:] for r in known.orderBy("block").collect()], float).reshape(-1, 3 + 2 * refs)
    stay = placed.select("block", "n", "id", "label", "v", "norm", "angles")
    asked = placed.where("asked").select(F.col("block").alias("home_block"), "n", "id", "label", "v", "norm", "angles")

    def same_label(block: _Rows, ids: pa.Array, a: _Rows, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        least = batch.column("least").to_numpy()
        wanted = (a.label[:, None] == block.label) & (a.n[:, None] != block.n)
        wanted &= score_limits(a, block)[1] >= least[:, None]
        found = scores(a, block, wanted)
        at, to = _first(found, _order(ids), positives)
        yield _rows_found(a, ids, at, to, 0, found)

    lowest = F.lit(float("-inf")).alias("least")
    near = staged(_meet(stay, _sent(asked.select("*", lowest), blocks, refs, True, True), same_label, _FOUND), "near")
    # The last of enough rows in the own block is the least that can matter elsewhere.
    least = near.groupBy("anchor").agg(F.count("*").alias("held"), F.min("score").cast("double").alias("low"))
    reached = F.when(F.col("held") >= positives, F.col("low") - F.abs("low") * _SCORE_ERROR).otherwise(float("-inf"))
    told = asked.join(least, F.col("n") == F.col("anchor"), "left").select(*asked.columns, F.coalesce(reached, F.lit(float("-inf"))).alias("least"))
    rest = _meet(stay, _sent(told, blocks, refs, True, False), same_label, _FOUND)
    best = staged(_best(near.unionByName(rest), positives), "positives")

    listed = F.array_sort(F.collect_list(F.struct("rank", "score")))
    with_positives = best.groupBy("anchor").agg(F.transform(listed, lambda x: x["score"]).alias("goals"))
    exact = F.aggregate("goals", F.lit(float("inf")), lambda m, x: F.least(m, x.cast("double")))
    # Windows of positives below 0 are empty; the least window begins at this score or above.
    least = F.when(exact > 0, exact * (low / 100) * (1 - _SCORE_ERROR) - 1).otherwise(F.lit(-1.0))
    told = asked.join(with_positives, F.col("n") == F.col("anchor")).select(*asked.columns, "goals", least.alias("least"))

    def other_labels(block: _Rows, ids: pa.Array, a: _Rows, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        goals = batch.column("goals").to_pylist()
        windows = [[_window(g, low, high) for g in own] for own in goals]
        begin = np.array([min((w[0] for w in own if w[0] <= w[1]), default=_MOST) for own in windows], float)
        end = np.array([max((w[1] for w in own if w[0] <= w[1]), default=_LEAST) for own in windows], float)
        under, over = score_limits(a, block)
        wanted = (a.label[:, None] != block.label) & (over >= begin[:, None]) & (under <= end[:, None])
        if not wanted.any():
            return
        found, order = scores(a, block, wanted), _order(ids)
        for w in range(max(map(len, windows))):
            lows = np.array([own[w][0] if w < len(own) else _MOST for own in windows], np.int64)[:, None]
            highs = np.array([own[w][1] if w < len(own) else _LEAST + 1 for own in windows], np.int64)[:, None]
            inside = np.where((found >= lows) & (found <= highs), found, _LEAST)
            at, to = _first(inside, order, negatives)
            if len(at):
                yield _rows_found(a, ids, at, to, w + 1, inside)

    hard = _best(_meet(stay, _sent(told, blocks, refs, False, None), other_labels, _FOUND), negatives)
    pairs = best.select(
        F.col("anchor").alias("a"), F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    names = placed.where("asked").select(F.col("n").alias("own"), F.col("id").alias("anchor_id"))
    return (
        hard.join(pairs, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w")))
        .join(names, F.col("anchor") == F.col("own"))
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
