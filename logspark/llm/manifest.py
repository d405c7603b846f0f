"""Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf; the leaves of a group (a language, say) make a tree, and the trees'
roots, ordered by group, make one tree above them. Both are built by time-forward
processing: nodes are swept in the order of their labels, children before parents, and a
priority queue ordered by label carries each digest to the parent that needs it. A second
sweep in reverse order carries proof suffixes, what a node needs from there to the root,
from parents to children.

Across tasks the queue is external: Spark's sorting shuffle keyed by blocks of
``fanout ** levels`` consecutive nodes, whose digests and suffixes arrive in label order
and spill to disk. One block's nodes are in memory at a time, so a group of any size is
spread over tasks, and ten thousand times the rows cost one round more.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import numbered, staged
from logspark.session import ship_package

FANOUT = 2
# Levels of a tree that one block holds.
LEVELS = 12


def field(value: Column) -> Column:
    """One value as a leaf hashes it: ``-`` for NULL, else its UTF-8 length, ``:``, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row with these values, as hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(digest: Column | str, proof: Column | str = "proof") -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(
        proof,
        F.col(digest) if isinstance(digest, str) else digest,
        lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]), 256),
    )


def siblings(proof: Column | str = "proof") -> Column:
    """All digests of a proof in one text, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(nodes: int, fanout: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def climb(digests: list[str], first: int, levels: int, fanout: int) -> Iterator[tuple[int, int, list[str]]]:
    """Sweep up from consecutive nodes from number ``first`` on: (level, number, children's digests).

    The queue holds (label, place among siblings, digest); a label is a level and a number in
    it, so all children of a node are out before the node is reached.
    """
    queue = [((1, n // fanout), n, d) for n, d in enumerate(digests, first)]  # sorted, so a heap
    while queue and queue[0][0][0] <= levels:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        yield (*label, children)
        heapq.heappush(queue, ((label[0] + 1, label[1] // fanout), label[1], _digest("".join(children))))


def descend(
    digests: list[str], first: int, levels: int, fanout: int, suffix: tuple
) -> list[tuple]:
    """Sweep down: the proof of each of these nodes, nearest step first, as nested pairs.

    ``suffix`` is the proof of the node they all lie under. A proof is (step, rest), and
    shares its rest with its siblings.
    """
    swept = list(climb(digests, first, levels, fanout))
    if not swept:
        return [suffix] * len(digests)
    proofs, queue = {}, [(-swept[-1][0], -swept[-1][1], suffix)]
    for level, number, children in reversed(swept):
        _, label, own = heapq.heappop(queue)
        assert -label == number
        for n, _ in enumerate(children):
            step = ("".join(children[:n]), "".join(children[n + 1 :]))
            child = number * fanout + n
            if level > 1:
                heapq.heappush(queue, (1 - level, -child, (step, own)))
            else:
                proofs[child] = (step, own)
    return [proofs[first + n] for n in range(len(digests))]


_PROOF = "array<struct<before:string,after:string>>"


class _Trees:
    """Trees of the rows of each ``group``: ``nth`` from 0 to ``total`` - 1, ``digest``, ``row``."""

    def __init__(self, leaves: DataFrame, fanout: int, levels: int, name: str):
        self.fanout, self.levels, self.block, self.name = fanout, levels, fanout**levels, name
        self.kind = leaves.schema["group"].dataType.simpleString()
        self.rounds = [leaves]
        most = leaves.agg(F.max("total")).first()[0] or 0
        while most > 1 or len(self.rounds) < 2:
            self.rounds.append(staged(self._up(self.rounds[-1]), f"{name}-nodes"))
            most = -(-most // self.block)

    def _block(self) -> Column:
        return (F.col("nth") / self.block).cast("long").alias("block")

    def _up(self, nodes: DataFrame) -> DataFrame:
        """The node above each block of nodes."""
        fanout, most, block, names = self.fanout, self.levels, self.block, ["group", "nth", "total", "digest"]

        def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (group, number), nodes in _blocks_of(batches):
                digests, total = nodes.column("digest").to_pylist(), nodes.column("total")[0].as_py()
                children = digests
                for _, _, children in climb(digests, number * block, min(most, _height(total, fanout)), fanout):
                    pass
                top = digests[0] if total == 1 else _digest("".join(children))
                kinds = [nodes.schema.field("group").type, pa.int64(), pa.int64(), pa.string()]
                values = (group, number, -(-total // block), top)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        own = nodes.select("group", self._block(), "nth", "total", "digest")
        return _swept(own).mapInArrow(up, f"group {self.kind}, nth long, total long, digest string")

    def roots(self) -> DataFrame:
        """``group`` and ``digest`` of each tree."""
        return self.rounds[-1].select("group", "digest")

    def proofs(self, tops: DataFrame) -> DataFrame:
        """Each leaf with its way to the top: ``group``, ``digest``, ``row``, ``subroot``, ``root``, ``proof``.

        ``tops`` has ``group``, ``subroot``, ``root`` and the ``proof`` of each tree's root.
        """
        found = tops.withColumn("nth", F.lit(0).cast("long"))
        for nodes in reversed(self.rounds[1:-1]):
            nodes = nodes.withColumn("row", F.lit(None).cast("int"))
            found = staged(self._down(nodes, found), f"{self.name}-proofs")
        return self._down(self.rounds[0], found)

    def _down(self, nodes: DataFrame, found: DataFrame) -> DataFrame:
        """Nodes of one round with what their blocks were found to need."""
        fanout, most, block = self.fanout, self.levels, self.block
        # A block's message sorts before its nodes.
        before = F.lit(-1).cast("long").alias("nth")
        sent = found.select("group", F.col("nth").alias("block"), before, "subroot", "root", "proof")
        own = nodes.select("group", self._block(), "nth", "total", "digest", "row")
        names = ["group", "nth", "digest", "row", "subroot", "root", "proof"]
        row = nodes.schema["row"].dataType.simpleString()

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, number), rows in _blocks_of(batches):
                message, nodes = rows.slice(0, 1), rows.slice(1)
                suffix: tuple = ()
                for step in reversed(message.column("proof")[0].as_py()):
                    suffix = ((step["before"], step["after"]), suffix)
                levels = min(most, _height(nodes.column("total")[0].as_py(), fanout))
                proofs = descend(nodes.column("digest").to_pylist(), number * block, levels, fanout, suffix)
                for at in range(0, len(proofs), 1024):
                    part = nodes.slice(at, 1024).combine_chunks().to_batches()[0]
                    told = [pa.array([message.column(c)[0].as_py()] * part.num_rows, pa.string()) for c in names[4:6]]
                    columns = [*(part.column(c) for c in names[:4]), *told, _proof_column(proofs[at : at + 1024])]
                    yield pa.RecordBatch.from_arrays(columns, names)

        stream = _swept(sent.unionByName(own, allowMissingColumns=True))
        schema = f"group {self.kind}, nth long, digest string, row {row}, subroot string, root string, proof {_PROOF}"
        return stream.mapInArrow(down, schema)


def _swept(rows: DataFrame) -> DataFrame:
    """The external queue: what is meant for a block meets in one task, in label order."""
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "nth")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Sorted rows block by block, whatever batches they come in."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("group").to_pylist(), batch.column("block").to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and key != keys[at]:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield key, pa.Table.from_batches(held)


def _proof_column(proofs: list[tuple]) -> pa.ListArray:
    ends, before, after = [0], [], []
    for proof in proofs:
        while proof:
            (left, right), proof = proof
            before.append(left)
            after.append(right)
        ends.append(len(before))
    steps = [pa.array(before, pa.string()), pa.array(after, pa.string())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(steps, ["before", "after"]))


def manifest(
    documents: DataFrame,
    digest: Column,
    *,
    group: str = "lang",
    order: str = "doc_id",
    fanout: int = FANOUT,
    levels: int = LEVELS,
    **extra: Column,
) -> DataFrame:
    """Every row's ``leaf``, ``subroot``, ``root`` and ``proof``, with ``group``, ``order`` and ``extra``.

    ``digest`` is a row's leaf (see :func:`leaf`). Leaves of a group ascend by ``order`` (NULL
    first), equal ones by digest; while several nodes remain, each run of ``fanout`` of them
    becomes the digest of their digests, the last run maybe of fewer. Groups ascend by UTF-8
    bytes (NULL, a group of its own, first). ``proof`` has a step for every level up to the
    root: the digests of the siblings ``before`` and ``after`` the node, empty texts if none.
    :func:`folded` recomputes the root from it. A block holds ``levels`` levels of a tree;
    the result does not depend on it.

    Repeated rows are leaves of their own. A text of any length is hashed by Spark and never
    sent on. Columns that are not named are ignored, so none can clash; an empty table gives
    no rows.
    """
    ship_package(documents.sparkSession)
    own = documents.select(
        F.col(group).alias("group"),
        F.col(order).alias("order"),
        digest.alias("digest"),
        F.struct(F.col(order).alias("order"), *[c.alias(n) for n, c in extra.items()]).alias("row"),
    )
    leaves = staged(_placed(own, ["order", "digest"]), "leaves")
    trees = _Trees(leaves, fanout, levels, "tree")
    tops = trees.roots().select(F.lit(0).alias("group"), F.struct(F.col("group")).alias("row"), "digest")
    tops = staged(_placed(tops, ["row"]), "subroots")
    above = _Trees(tops, fanout, levels, "top")
    root = above.roots().select(F.col("group"), F.col("digest").alias("root"))
    none = F.expr(f"CAST(array() AS {_PROOF})")
    start = root.select("group", F.lit("").alias("subroot"), "root", none.alias("proof"))
    known = above.proofs(start).select(
        F.col("row.group").alias("group"), F.col("digest").alias("subroot"), "root", "proof"
    )
    out = trees.proofs(staged(known, "subroot-proofs"))
    names = [F.col(f"row.{n}").alias(n) for n in extra]
    return out.select(
        F.col("group").alias(group), F.col("row.order").alias(order), *names,
        F.col("digest").alias("leaf"), "subroot", "root", "proof",
    )


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their number ``nth`` in their group and its size ``total``."""
    each, starts = numbered(rows, "group", order)
    starts = starts.select(F.col("part").alias("p"), F.col("group").alias("g"), "first", "total")
    same = (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g"))
    return each.join(starts, same).select(*rows.columns, (F.col("first") + F.col("nth")).alias("nth"), "total")
