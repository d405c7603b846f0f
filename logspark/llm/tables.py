"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.session import scratch_path, ship_package

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; ships the package first, for the operators' Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs tasks of the reading job only, and what made
    the table is not run again for each use. Results read the table, so it stays until
    :func:`release_staged`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.pop(path, None)


def release_staged() -> None:
    """Delete all staged tables of this process; results made from them end with them."""
    for path, spark in list(_written.items()):
        _delete(spark, path)


class Steps:
    """Tables of an operator of many steps, each deleted when no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, last_use_of: Iterable[str] = ()) -> DataFrame:
        """Stage ``df`` as ``name``; the tables it was the last to use are deleted."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        _written[path] = self.spark
        self.paths[name] = path
        schema = df.schema
        del df
        self.drop(*last_use_of)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables. A collection lets Spark's cleaner delete the steps' shuffle files."""
        for name in names:
            _delete(self.spark, self.paths.pop(name))
        gc.collect()
        self.spark._jvm.System.gc()


def packed(df: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` beside the whole row as struct ``row``, so that no name can clash."""
    return df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def numbered(df: DataFrame, group: str, order: Iterable[str | Column] = ()) -> tuple[DataFrame, DataFrame]:
    """Number the rows of every group without bringing a group together.

    Rows are range-partitioned by ``group``, ``order`` and their place in ``df``, so that a
    group of any size, one of equal rows too, lies in many tasks in order (NULL first).
    Returns the rows, staged, with ``part`` and ``nth`` (from 0 within part and group), and
    ``starts``: ``part``, ``group``, ``first`` (the group's rows in earlier parts), ``rows`` in
    this part and ``total`` of the group. ``starts`` has at most one row for each group and
    part more than there are groups.
    """
    placed = staged(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    keys = [group, *order, "_at"]
    ranged = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranged.schema)}, part int, nth long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(group))
            codes = pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            nth = np.arange(len(codes)) - np.repeat(begins, np.diff(np.r_[begins, len(codes)]))
            if values[0].as_py() == last and seen:
                nth[: begins[1] if len(begins) > 1 else len(nth)] += seen
            last, seen = values[-1].as_py(), int(nth[-1]) + 1
            extra = [pa.array(np.full(len(nth), part, np.int32)), pa.array(nth.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "nth"])

    rows = staged(ranged.mapInArrow(count, schema), "numbered")
    each = rows.groupBy("part", group).agg(F.count("*").alias("rows"))
    ordered = Window.partitionBy(group)
    before = ordered.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(
        "part", group, "rows",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"),
        F.sum("rows").over(ordered).alias("total"),
    )
    return rows, starts
