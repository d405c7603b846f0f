"""Files that Spark's listing passes over, found by walking folders on the executors.

Spark never lists names starting with ``_``. The walk keeps a frontier of folders: each
round, tasks list a bounded number of them and hand on what is left, so a tree of any width
is spread over the cluster and its names never meet on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.patterns import glob_matches
from logspark.session import cut_lineage, ship_package
from logspark.sources.files import locate

# Folders that one task lists before it hands the rest on.
FOLDERS_PER_TASK = 1_000
_WILDCARD = re.compile(r"[*?\[{]")
_NODE = "path string, rest array<string>, hidden boolean, size bigint"
_ARROW = pa.schema(
    [("path", pa.string()), ("rest", pa.list_(pa.string())), ("hidden", pa.bool_()), ("size", pa.int64())]
)


def without_braces(glob: str) -> list[str]:
    """The globs that ``{a,b}`` stands for; ``\\`` takes the next character's meaning."""
    pieces = re.findall(r"\\.|[{},]|[^\\{},]+", glob, re.DOTALL)
    groups: list[list[list[str]]] = [[[""]]]  # open braces, alternatives, texts so far
    for piece in pieces:
        if piece == "{":
            groups.append([[""]])
        elif piece == "," and len(groups) > 1:
            groups[-1].append([""])
        elif piece == "}" and len(groups) > 1:
            options = [text for alternative in groups.pop() for text in alternative]
            groups[-1][-1] = [a + b for a, b in product(groups[-1][-1], options)]
        else:
            groups[-1][-1] = [text + piece for text in groups[-1][-1]]
    if len(groups) > 1:
        raise ValueError(f"unclosed brace in {glob!r}")
    return list(dict.fromkeys(groups[0][0]))


def _starts(root: str) -> Iterator[dict]:
    """Where the walk below a root begins: the path before the first wildcard, and what is to match."""
    for path in without_braces(root) if _WILDCARD.search(root) else [root]:
        parts = path.split("/")
        first = next((i for i, p in enumerate(parts) if _WILDCARD.search(p)), len(parts))
        yield {"path": "/".join(parts[:first]) or "/", "rest": [p for p in parts[first:] if p], "hidden": False, "size": -1}


def _entries(path: str) -> Iterator[tuple[str, str, int]]:
    """Name, path and size (-1 for a folder) of what lies in a folder; nothing if it is none."""
    system, inner = locate(path)
    local = isinstance(system, fs.LocalFileSystem)
    prefix = "file:" if local else path[: -len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return
    for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        yield info.base_name, prefix + info.path, info.size if info.is_file else -1


def _below(node: dict) -> Iterator[dict]:
    """One step: what lies in a folder and belongs to the walk."""
    rest = node["rest"]
    for name, path, size in _entries(node["path"]):
        if name.startswith(".") and not (rest and rest[0].startswith(".")):
            continue
        here = name.startswith("_") and "=" not in name
        if rest:
            if not glob_matches(name, rest[0]) or (size >= 0 and len(rest) > 1):
                continue
            # What a wildcard names is a root: Spark lists a folder, but not such a file.
            yield {"path": path, "rest": rest[1:], "hidden": size >= 0 and here, "size": size}
        else:
            yield {"path": path, "rest": rest, "hidden": node["hidden"] or here, "size": size}


def _walk(most: int):
    """Task body: files below the given folders, and folders that are still to be listed."""
    def rows(nodes: list[dict]) -> Iterator[dict]:
        listed = 0
        while nodes and listed < most:
            node, listed = nodes.pop(), listed + 1
            for found in _below(node):
                if found["size"] < 0:
                    nodes.append(found)
                elif found["hidden"]:
                    yield found
        yield from nodes

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for row in rows(batch.to_pylist()):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return walk


def underscored_files(spark: SparkSession, roots: list[str], folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """``path`` and ``size`` of the files that Spark passes over for a name starting with ``_``.

    That is any name below a root, or a file that a root's wildcard names. Names starting with a
    dot stay out, as everywhere, as do names like ``_a=b``, which Spark lists. Roots are folders
    or have wildcards as Spark takes them. A path is given once.
    """
    ship_package(spark)
    cores = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([n for root in roots for n in _starts(root)], _NODE)
    found: list[DataFrame] = []
    while True:
        round = cut_lineage(frontier.mapInArrow(_walk(folders_per_task), _NODE))
        found.append(round.where("size >= 0").select("path", "size"))
        frontier = round.where("size < 0")
        if frontier.isEmpty():
            break
        frontier = frontier.repartition(8 * cores)
    return reduce(DataFrame.unionByName, found).dropDuplicates(["path"])
