"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share is above its largest
number of epochs is clamped there and the excess goes to the others by weight, again and
again until no share is too large. The budget of a source is then spent on whole
repetitions of every document and a seeded sample for the fraction: documents in the
order of a hash, the last of them cut so that the budget is met to the word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
# Hash digits that cut a source into buckets; running sums go over buckets, then over
# the documents of one bucket of each source.
_BUCKET_DIGITS = 3


def cycled_weights(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sources`` (column ``source``) with ``weight`` taken in turn by code point, NULL last.

    Ranks are counted per range of names, so the names are never in one task.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    placed = staged(
        sources.repartitionByRange(*by_name)
        .sortWithinPartitions(*by_name)
        .select("*", F.monotonically_increasing_id().alias("at")),
        "sources",
    )
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total)]
        total += counts[p]
    if not total:
        return placed.drop("at").withColumn("weight", F.lit(0))
    rank = F.create_map(*before)[part] + row
    chosen = F.array(*[F.lit(w) for w in weights])[(rank % len(weights)).cast("int")]
    return placed.withColumn("weight", chosen).drop("at")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (``source``, ``words``, ``weight``) with column ``target``.

    Targets add up to ``share`` of all words unless every source is at its cap. Only sums
    reach the driver, one row per round.
    """
    total = sources.agg(F.sum("words")).first()[0] or 0
    cap = (F.col("words") * max_epochs).cast("double")
    target: Column = cap
    open_ = F.lit(True)
    left, last = share * total, -1
    while True:
        row = sources.where(open_).agg(F.sum("weight"), F.count("*")).first()
        if not row[1] or row[1] == last:
            return sources.withColumn("target", F.when(open_, target).otherwise(cap))
        capped = sources.where(~open_).agg(F.sum(F.col("words") * max_epochs)).first()[0] or 0
        left, last = share * total - capped, row[1]
        target = F.lit(float(left)) * F.col("weight") / F.lit(float(row[0]))
        open_ = open_ & (target <= cap)


def mix(
    documents: DataFrame,
    *,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` is the number of words (NULL text: 0), ``taken`` the words the mix takes of
    it with repeats: whole repetitions plus, for the fraction, all of it, none, or for one
    document of each source its first words. ``taken`` adds up to ``target`` rounded down
    to a word and is at most ``max_epochs`` times ``size``. NULL sources are one source.
    The sample depends on ids, sizes and ``seed`` alone; repeated rows are told apart by
    nothing, so either may be the one taken. No rows give no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    sized = staged(
        documents.select(
            F.col(id).alias("id"),
            F.col(source).alias("source"),
            words.cast("long").alias("size"),
            order.alias("h"),
        ),
        "sizes",
    )
    bucket = F.substring("h", 1, _BUCKET_DIGITS)
    buckets = staged(
        sized.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words")), "buckets"
    )
    sources = buckets.groupBy("source").agg(F.sum("words").alias("words"))
    filled = staged(water_fill(cycled_weights(sources, weights), share, max_epochs), "targets")
    budget = F.floor("target").cast("long")
    plan = filled.select(
        F.col("source").alias("s"),
        F.col("words").alias("source_size"),
        "target",
        F.when(F.col("words") > 0, F.expr("cast(floor(target) as bigint) div words"))
        .otherwise(F.lit(0))
        .alias("whole"),
    ).withColumn("rest", F.when(F.col("source_size") > 0, budget - F.col("whole") * F.col("source_size")).otherwise(F.lit(0)))
    # The bucket in which the rest of each source ends, and the words before it.
    running = F.expr("sum(words) over (partition by source order by b)")
    edges = (
        buckets.select("source", "b", "words", running.alias("upto"))
        .join(plan, F.col("source").eqNullSafe(F.col("s")))
        .where("upto - words < rest and rest <= upto")
        .select(F.col("s").alias("e"), F.col("b").alias("edge"), (F.col("upto") - F.col("words")).alias("before"))
    )
    plan = staged(
        plan.join(edges, F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "plan"
    )
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("b", bucket)
    whole = joined.select(
        "id", "source", "size", "source_size", "target", "h", "whole", "rest", "b", "edge", "before"
    )
    inside = F.expr(
        "sum(size) over (partition by source order by h, size, id"
        " rows between unbounded preceding and current row) - size"
    )
    at_edge = whole.where("b = edge").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - inside)))
    off_edge = whole.where("edge is null or b <> edge").withColumn(
        "part", F.when(F.col("b") < F.col("edge"), F.col("size")).otherwise(F.lit(0))
    )
    return at_edge.unionByName(off_edge).select(
        "id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )
