"""Best-fit-decreasing packing of tokenized documents into sequences.

Documents become token ids with an end id and are cut into pieces of at most one sequence.
Best-fit decreasing places every piece, longest first, into the open sequence with the
least room that still holds it. What it does depends on lengths alone, so it is run over
their histogram, which has at most ``max_tokens`` rows whatever the number of documents: a
segment tree over remaining capacities gives the tightest one that is open in logarithmic
time, and as pieces of one length fill a sequence before the next is touched, a *run* of
them into sequences of equal room is one step. Pieces are numbered within their length in
Spark, and each finds its place from the run that holds its number.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import numbered
from logspark.session import ship_package

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
MAX_TOKENS = 4096
END_ID = 1
# Words whose ids a worker remembers; beyond that it starts anew.
_REMEMBERED = 700_000
_LONGEST_REMEMBERED = 48
# Output rows are sent on from so many bytes of ids.
_FLUSH_BYTES = 8 << 20
# How the vocabulary's tokenizer parts text (fixed by its file).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Latin letters, digits and marks that composition leaves alone, and the same parts for them.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_MARKS = "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2013\u2014\u2018-\u201e\u2026\u20ac"
_PLAIN = re.compile(f"[A-Z\u00c0-\u00d6\u00d8-\u00de{_LETTERS}0-9{_MARKS} \\t\\n\\r]*").fullmatch
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+").findall
_MARKS_MEET = re.compile(f"[{_MARKS}][,.] ").search


class WordIds:
    """Ids of texts, found word by word.

    This kind of tokenizer drops white space, and neither its normalisation nor its merges
    reach across it, so the ids of a text are those of its blank-separated words in order.
    Words repeat; each is encoded once. Texts of plain characters, on which normalisation
    does no more than lower-case, are parted here and only parts of new words are merged by
    the tokenizer's model; all others go through the whole tokenizer. Ids are little-endian
    unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        described = json.loads(self._tokenizer.to_str())
        steps = described["pre_tokenizer"].get("pretokenizers", [described["pre_tokenizer"]])
        split = next((p for p in steps if p["type"] == "Split"), {})
        if (split.get("behavior"), split.get("invert")) != ("Removed", True):
            raise ValueError(f"{path}: only for tokenizers that drop white space between words")
        self._model = self._tokenizer.model
        self._reserved = [t["content"] for t in described["added_tokens"]]
        self._parts_known = split["pattern"] == {"Regex": _SPLIT} and [
            n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"]
        one_by_one = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        beyond = (chr(c) for c in range(0x80, 0x2100) if _PLAIN(chr(c)))
        self._bytes = {ord(c): one_by_one(c)[0][0] for c in beyond}
        self._words = _Words(self._ids)

    def _ids(self, word: str) -> bytes:
        ids = array("I")
        for part in _PARTS(word):
            mapped = part if part.isascii() else part.translate(self._bytes)
            ids.extend([t.id for t in self._model.tokenize(mapped)])
        return ids.tobytes()

    def of(self, text: str) -> bytes:
        if len(self._words) > _REMEMBERED:
            self._words.clear()
        plain = bool(self._parts_known and _PLAIN(text)) and not any(r in text for r in self._reserved)
        if plain:
            text = text.lower()
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if plain and not _MARKS_MEET(text):
            # A part ends before such a mark; words without it are known more often.
            text = text.replace(", ", " , ").replace(". ", " . ")
        words = text.split(" ")
        if plain:
            return b"".join(map(self._words.__getitem__, words))
        new = list(set(words).difference(self._words))
        encoded = self._tokenizer.encode_batch(new, add_special_tokens=False)
        self._words.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, encoded, strict=True))
        found = b"".join(map(self._words.__getitem__, words))
        for word in new:
            if len(word) > _LONGEST_REMEMBERED:
                del self._words[word]
        return found


class _Words(dict):
    """Ids of words, found when first asked for; long words are not kept."""

    def __init__(self, ids: Callable[[str], bytes]):
        self._ids = ids

    def __missing__(self, word: str) -> bytes:
        found = self._ids(word)
        if len(word) <= _LONGEST_REMEMBERED:
            self[word] = found
        return found


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The tokenizer of a file, read once in each worker."""
    return WordIds(path)


def tokenized_pieces(
    documents: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    tokenizer: str = TOKENIZER,
    ids: bool = False,
) -> DataFrame:
    """Pieces of every document: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, maybe ``ids``.

    A document's ids are those of its text and then ``end_id``; a NULL text counts as empty.
    Only documents of more than ``max_tokens`` ids are cut, into pieces of ``max_tokens``.
    ``ids`` are little-endian unsigned 32-bit integers, ``ids_crc32`` their unsigned CRC.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * ids
    end, size = np.array([end_id], "<u4").tobytes(), 4 * max_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch in batches:
            own, columns, held = [], [[] for _ in range(4 + ids)], 0
            for at, value in enumerate(batch.column(1)):
                whole = coder.of(value.as_py()) + end
                for piece, begin in enumerate(range(0, len(whole), size)):
                    part = whole[begin : begin + size]
                    row = (piece, begin // 4, len(part) // 4, zlib.crc32(part), part)
                    own.append(at)
                    for column, x in zip(columns, row, strict=False):
                        column.append(x)
                    held += len(part) * ids + 64
                    if held >= _FLUSH_BYTES:
                        yield _pieces(batch.column(0), own, columns)
                        own, columns, held = [], [[] for _ in range(4 + ids)], 0
            if own:
                yield _pieces(batch.column(0), own, columns)

    return rows.mapInArrow(cut, schema)


def _pieces(own_ids: pa.Array, own: list[int], columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = ("id", "piece", "start", "length", "ids_crc32", "ids")
    arrays = [own_ids.take(pa.array(own, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))]
    return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])


class OpenRooms:
    """Segment tree over remaining capacities; a leaf holds the ranges of bins with that room."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._open = bytearray(2 * self._leaves)
        self._ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, room: int, first: int, bins: int) -> None:
        """Bins ``first`` to ``first + bins`` have this room."""
        if not (room and bins):
            return
        self._ranges[room].append((first, bins))
        node = self._leaves + room
        while node and not self._open[node]:
            self._open[node] = 1
            node //= 2

    def take(self, room: int) -> tuple[int, int]:
        """A range of bins of this room, which are then no longer open."""
        taken = self._ranges[room].pop()
        node = self._leaves + room
        if not self._ranges[room]:
            self._open[node] = 0
            while node > 1 and not (self._open[node] | self._open[node ^ 1]):
                node //= 2
                self._open[node] = 0
        return taken

    def tightest(self, least: int) -> int:
        """The smallest open room of at least ``least``, 0 if there is none."""
        node = self._leaves + least
        if self._open[node]:
            return least
        while node > 1 and (node & 1 or not self._open[node + 1]):
            node //= 2
        if node <= 1:
            return 0
        node += 1
        while node < self._leaves:
            node = 2 * node + (not self._open[2 * node])
        return node - self._leaves


def best_fit_runs(histogram: Iterable[tuple[int, int]], size: int) -> np.ndarray:
    """Best-fit decreasing over (length, number of pieces), lengths from 1 to ``size``.

    Rows (length, nth, bin, per_bin, offset): the pieces of this length from number ``nth``
    on go ``per_bin`` each into bins from ``bin`` on, from ``offset`` on, up to the next run.
    """
    rooms, bins, runs = OpenRooms(size), 0, []
    for length, count in sorted(histogram, reverse=True):
        nth = 0
        while nth < count:
            room = rooms.tightest(length)
            if not room:
                new = -(-(count - nth) // (size // length))
                rooms.put(size, bins, new)
                bins += new
                continue
            first, n = rooms.take(room)
            per_bin = room // length
            runs.append((length, nth, first, per_bin, size - room))
            full = min(n, (count - nth) // per_bin)
            nth += full * per_bin
            rooms.put(room - per_bin * length, first, full)
            if full < n:
                rest = min(per_bin, count - nth)
                nth += rest
                if rest:
                    rooms.put(room - rest * length, first + full, 1)
                    full += 1
                rooms.put(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(
    documents: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    tokenizer: str = TOKENIZER,
    ids: bool = False,
) -> DataFrame:
    """Place all pieces of all documents: the columns of :func:`tokenized_pieces`, ``sequence_id``, ``offset``.

    ``sequence_id`` counts from 0 without gaps, and so do offsets within a sequence. The
    number of sequences is that of best-fit decreasing over all pieces at once; of equal
    lengths any piece may come first. With ``ids`` the pieces' ids are carried along, and
    :func:`sequences` makes whole sequences of them.

    A NULL or empty text is one piece, the end id. Ids may be NULL or repeat, and a repeated
    row is packed as often as it comes. Long texts are cut into pieces, never shortened.
    Other columns are ignored, so none can clash; an empty table gives no rows.
    """
    pieces = tokenized_pieces(
        documents, id=id, text=text, max_tokens=max_tokens, end_id=end_id, tokenizer=tokenizer, ids=ids
    )
    rows, starts = numbered(pieces, "length")
    # At most max_tokens lengths, and one row more for each boundary between parts.
    found = starts.select("length", "part", "first", "total").collect()
    runs = best_fit_runs({(r.length, r.total) for r in found}, max_tokens)
    firsts = {(r.length, r.part): r.first for r in found}
    names = [c for c in rows.columns if c not in ("part", "nth")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {length: runs[runs[:, 0] == length] for length in np.unique(runs[:, 0]).tolist()}
        for batch in batches:
            length, part, nth = (batch.column(c).to_numpy() for c in ("length", "part", "nth"))
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for key in set(zip(length.tolist(), part.tolist(), strict=True)):
                at = np.flatnonzero((length == key[0]) & (part == key[1]))
                number = nth[at] + firsts[key]
                mine = own[key[0]]
                _, begin, first, per_bin, before = mine[np.searchsorted(mine[:, 1], number, "right") - 1].T
                sequence[at] = first + (number - begin) // per_bin
                offset[at] = before + (number - begin) % per_bin * key[0]
            columns = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of pieces packed with ``ids``: ``sequence_id``, ``length``, ``ids``, ``documents``.

    A sequence has at most ``max_tokens`` pieces. ``documents`` are their ids in order.
    """
    piece = F.struct("offset", "length", "ids", "id")
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(piece)).alias("p"))
        .select(
            "sequence_id",
            F.aggregate("p", F.lit(0), lambda n, x: n + x["length"]).alias("length"),
            F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
            F.transform("p", lambda x: x["id"]).alias("documents"),
        )
    )
