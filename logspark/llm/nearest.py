"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is learned on a bounded sample; every row is put into one of its leaves. A query
walks the tree best bin first: a priority queue holds nodes by the inner product with
their centre, and leaves are visited in that order. How many are visited is calibrated:
for a set of queries the exact neighbours among all rows are found once, and visits are
widened until the leaves reached hold the wanted share of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.tables import staged
from logspark.session import ship_package

K = 20
# Vectors the tree is learned from, at most about this many.
SAMPLE = 20_000
BRANCHES = 16
# Small leaves need more visits, each of which is a row that meets a leaf in a shuffle.
LEAF_SAMPLE = 256
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.96
# Rows and queries that are compared in one task at once.
BLOCK = 4096
SEED = 42


@dataclass
class Tree:
    """Nodes with centres of their children; a child without centres is a leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # number of the leaf, or -1
    leaves: int = 0

    def grow(self, points: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.leaf)
        self.centres.append(np.empty((0, points.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        if len(points) > LEAF_SAMPLE:
            centres, owner = _k_means(points, min(BRANCHES, math.ceil(len(points) / LEAF_SAMPLE * 2)), rng)
            if len(centres) > 1:
                self.centres[node] = centres
                self.children[node] = [self.grow(points[owner == i], rng) for i in range(len(centres))]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def assign(self, points: np.ndarray, node: int = 0) -> np.ndarray:
        """The leaf of each point, by the nearest centre on each level."""
        if self.leaf[node] >= 0:
            return np.full(len(points), self.leaf[node])
        owner, result = _nearest(points, self.centres[node]), np.empty(len(points), np.int64)
        for i, child in enumerate(self.children[node]):
            mine = owner == i
            if mine.any():
                result[mine] = self.assign(points[mine], child)
        return result

    def visit(self, query: np.ndarray, visits: int, rows: np.ndarray, least: int) -> list[int]:
        """Leaves in the order of the traversal: ``visits``, and more until they hold ``least`` rows."""
        queue, order, held = [(0.0, 0)], [], 0
        while queue and (len(order) < visits or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                order.append(self.leaf[node])
                held += rows[self.leaf[node]]
            else:
                near = self.centres[node] @ query
                for child, score in zip(self.children[node], near.tolist()):
                    heapq.heappush(queue, (-score, child))
        return order


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8):
    """Centres that own a point, and the owner of each point."""
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        owner = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        counts = np.bincount(owner, minlength=len(centres))
        centres = sums[counts > 0] / counts[counts > 0, None]
    owner = _nearest(points, centres)
    used, owner = np.unique(owner, return_inverse=True)
    return centres[used], owner


def _usable(vector: Column) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _top(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query the positions of its ``k`` best rows and their exact scores.

    The matrix product only preselects: its last digits depend on where a row stands, so
    equal rows would not tie. Scores are summed row by row.
    """
    rough = queries @ rows.T
    k = min(k, len(rows))
    slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    least = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k] - slack
    for i, query in enumerate(queries):
        at = np.flatnonzero(rough[i] >= least[i])
        score = (rows[at] * query).sum(axis=1)
        best = np.lexsort((ids[at], -score))[:k]
        yield at[best], score[best]


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float) -> int:
    """Leaves to visit so that the share ``target`` of exact neighbours is reached."""
    chosen = queries.orderBy(F.xxhash64("qid")).limit(CALIBRATION_QUERIES).toPandas()
    if not len(chosen) or tree.leaves < 2:
        return tree.leaves
    points, own = _matrix(chosen.vector), chosen.qid.to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, ids = _matrix(batch.vector), batch.id.to_numpy()
            for q, (at, score) in zip(own, _top(points, rows, ids, k + 1)):
                out = pd.DataFrame({"qid": q, "id": ids[at], "leaf": batch.leaf.to_numpy()[at], "score": score})
                yield out[out.id != q]

    best = index.select("id", "vector", "leaf").mapInPandas(exact, "qid long, id long, leaf long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    truth = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).toPandas()
    none = np.zeros(tree.leaves)
    rank = {q: {leaf: i for i, leaf in enumerate(tree.visit(p, tree.leaves, none, 0))} for q, p in zip(own, points)}
    needed = np.sort([rank[q][leaf] + 1 for q, leaf in zip(truth.qid, truth.leaf)])
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))]) if len(needed) else tree.leaves


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """The ``k`` rows of largest inner product for each query, nearest first.

    Returns ``query_id``, ``rank`` (from 1), ``id``, ``score`` (inner product in double
    precision of the vectors as given); ties go to the smaller id. ``is_query`` is a
    condition on the columns of ``vectors``. Vectors that are NULL, zero, of another
    length than most, or hold NULL or non-finite components take no part. Equal rows are
    one candidate; no row of the query's own id is one. A row without id can be found (its
    id is NULL, last among ties) but is no query. Fewer candidates give fewer rows, empty
    tables none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    last = (1 << 63) - 1
    own = vectors.select(
        F.coalesce(F.col(id).cast("long"), F.lit(last)).alias("id"),
        F.transform(F.col(vector), lambda v: v.cast("double")).alias("vector"),
        (F.coalesce(is_query, F.lit(False)) & F.col(id).isNotNull()).alias("asks"),
    ).where(_usable(F.col("vector")))
    sizes = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    answer = "query_id long, rank int, id long, score double"
    if sizes is None:
        return spark.createDataFrame([], answer)
    own = own.where(F.size("vector") == sizes[0])
    share = min(1.0, SAMPLE / sizes[1])
    picked = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
    sample = own.where(picked).select("vector").distinct().limit(2 * SAMPLE).toPandas()
    tree = Tree()
    tree.grow(np.unique(_matrix(sample.vector), axis=0), np.random.default_rng(SEED))
    sent = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("long")
    def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(sent.value.assign(_matrix(batch)) if len(batch) else [], dtype="int64")

    index = staged(own.select("id", "vector").distinct().withColumn("leaf", leaf_of("vector")), "index")
    # Queries with one vector are searched once.
    asked = staged(own.where("asks").groupBy("vector").agg(F.min("id").alias("qid")), "queries")
    visits = _calibrate(index, asked, tree, k, target_recall)
    # Rows of a query's own id are found before they are taken out.
    more = own.where("asks").select("id").distinct().join(index, "id").groupBy("id").count().agg(F.max("count")).first()[0] or 0
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # one row for each leaf
        sizes[leaf] = n

    @F.pandas_udf("array<long>")
    def leaves_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sent.value.visit(np.asarray(q, np.float64), visits, sizes, k + more) for q in batch])

    reached = staged(asked.select("qid", "vector", F.explode(leaves_of("vector")).alias("leaf")), "visits")
    # Large leaves and leaves with many queries are cut; there is one row for each leaf.
    parts = F.broadcast(
        index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("row_parts"))
        .join(reached.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_parts")), "leaf")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (
        index.join(parts, "leaf")
        .withColumn("a", F.pmod(F.xxhash64("id", "vector"), F.col("row_parts")).cast("int"))
        .withColumn("b", every("query_parts"))
    )
    queries = (
        reached.join(parts, "leaf")
        .withColumn("b", F.pmod(F.xxhash64("qid"), F.col("query_parts")).cast("int"))
        .withColumn("a", every("row_parts"))
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        ids = left.id.to_numpy()
        found = list(_top(_matrix(right.vector), _matrix(left.vector), ids, k + more))
        return pd.DataFrame(
            {
                "qid": np.repeat(right.qid.to_numpy(), [len(at) for at, _ in found]),
                "id": np.concatenate([ids[at] for at, _ in found]),
                "score": np.concatenate([score for _, score in found]),
            }
        )

    grouped = rows.select("leaf", "a", "b", "id", "vector").groupBy("leaf", "a", "b")
    matches = grouped.cogroup(queries.select("leaf", "a", "b", "qid", "vector").groupBy("leaf", "a", "b")).applyInPandas(
        compare, "qid long, id long, score double"
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = staged(
        matches.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + more).drop("r"), "found"
    )
    ids = own.where("asks").select(F.col("id").alias("query_id"), "vector").distinct()
    named = ids.join(asked, "vector").select("query_id", "qid").join(best, "qid").where("id <> query_id")
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        named.withColumn("rank", F.row_number().over(again))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("id", F.lit(last)).alias("id"), "score")
    )
