"""Anti joins of lines against a table of keys to leave out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of keys is broadcast up to this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024

# A key with more than this share of all lines has them spread over several salts. At
# most ``1 / share`` keys can have it.
HOT_SHARE = 0.001


def key_bytes(keyed: DataFrame, keys: Sequence[str]) -> int | None:
    """Bytes that the keys take in memory, None if there are no rows."""
    row = [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 64 for k in keys]
    return keyed.agg(F.sum(reduce(lambda a, b: a + b, row))).first()[0]


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys are not in ``right``; NULL equals NULL."""
    right = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, reduce(lambda a, b: a & b, same), "left_anti")


def salted_anti_join(
    lines: DataFrame,
    left_out: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    *,
    salt_on: Sequence[str],
) -> DataFrame:
    """Shuffled anti join in which no key sends more than a small share to one task.

    ``sizes`` holds the keys with their number of ``lines``. Keys above ``HOT_SHARE`` of
    all lines are at most ``1 / HOT_SHARE`` in number, so their salts can be broadcast.
    Lines are dealt over the salts of their key by a hash of ``salt_on``.
    """
    total = sizes.agg(F.sum("lines")).first()[0] or 0
    per_salt = max(int(total * HOT_SHARE), 1)
    hot = sizes.where(F.col("lines") > per_salt).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.ceil(F.col("lines") / per_salt).cast("int").alias("_salts"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]

    def with_salts(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(hot), reduce(lambda a, b: a & b, same), "left")
        return joined.withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    salt = F.pmod(F.xxhash64(*salt_on), F.col("_salts")).cast("int")
    left = with_salts(lines).select(*lines.columns, salt.alias("_salt"))
    every = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    right = with_salts(left_out).select(*keys, every.alias("_salt"))
    return anti_join(left, right, [*keys, "_salt"]).drop("_salt")
