"""Session helpers: checkpoint folder, scratch folders, spreading of narrow scans."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Settings that suit the generated code of the parse: methods above 8000 bytes of code
# are not compiled by HotSpot, so larger ones are better split up.
TUNING = {
    # A line that repeats a key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Rows of a narrow table that one task takes at most, before lines are made of them and parsed.
ROWS_PER_TASK = 50_000

_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended session settings; results do not depend on them."""
    for name, value in TUNING.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logspark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never handed out twice."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of every executor import this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="logspark-")) / "logspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once and keep the result in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, files: int | None = None) -> DataFrame:
    """Deal rows out evenly over the cores, for few files that cannot be split.

    Meant for gzip, xz and tar files, before the costly parse.
    With ``files``, nothing is done from as many files on as there are cores. Decided
    without planning or running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or (files is not None and files >= cores):
        return df
    return df.repartition(cores)


def spread_table(table: DataFrame) -> DataFrame:
    """Deal the rows of a narrow table out evenly: a task a core, and more tasks for more rows.

    Its files are small for the work its rows make, so neither their bytes nor the number of
    cores may say how long a task gets. The rows are counted from what the files say of themselves.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, -(-table.count() // ROWS_PER_TASK)))


@contextmanager
def listing_in_few_tasks(spark: SparkSession, per_core: int = 8) -> Iterator[None]:
    """While it lasts, Spark lists folders by a few tasks for each core.

    Otherwise it makes a task of each folder, and starting it takes longer than its work.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
