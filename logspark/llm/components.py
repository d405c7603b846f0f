"""Connected components of an undirected graph by alternating star steps.

Each round hangs neighbours below the least node they know. The number of rounds grows
with the logarithm of the largest distance inside a component. Edges stay distributed;
only a count and a checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.union(kept).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has columns ``u`` and ``v`` of one ordered type, in any direction, with
    repeats; edges with a NULL end or both ends equal are ignored. Returns ``node`` and
    ``component``, the least node of its component; no rows for no edges.
    """
    edges = staged(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        edges = staged(_small_star(_large_star(edges)), "edges")
        checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("c")
        now = tuple(edges.agg(F.count("*"), checksum).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
