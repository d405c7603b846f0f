r"""Chat formatting on tokens.

Each turn is ``[INST]role[/INST]text</s>``. Role and text are encoded apart and the marks
are spliced in as reserved ids above the vocabulary, so no text can form a mark. Loss
masks come from prefix sums over segment ends. In the rendered string, marks that occur
in a text get a backslash after their first character (``<\/s>``); marks that have
backslashes there already get one more, so every text can be read back.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.session import ship_package

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the byte-level vocabulary parts text before merging (fixed by the vocabulary).
_PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer texts are encoded in pieces of about this length, cut where the pattern surely parts
# them: no match goes on from a character into white space. The ids stay those of the whole.
_PIECE = 100_000
_SURE_END = re.compile(r"\S(?=[ \n])")
# Only a run of white space as long as a piece is cut anywhere: the pattern cannot match it.
_LONG_BLANKS = re.compile(rf"\s{{{_PIECE},}}")
_BLOCK_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a turn and the roles whose text is trained on."""

    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    others: tuple[str, ...] = ("<s>",)  # further reserved strings, escaped in texts as well
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for mark in self.marks:
            if len(mark) < 2 or mark[0] in mark[1:] or "\\" in mark:
                raise ValueError(f"unsuited mark {mark!r}")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.open, self.close, self.end, *self.others)

    def _pattern(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(re.escape(m[0]) + slashes + re.escape(m[1:]) for m in self.marks))

    @cached_property
    def _bare(self) -> re.Pattern:
        return self._pattern(r"\\*")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return self._pattern(r"\\+")

    def escape(self, text: str) -> str:
        return self._bare.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        sure = _SURE_END.search(text, at + _PIECE - 1)
        piece = text[at : sure.end() if sure else len(text)]
        at += len(piece)
        if _LONG_BLANKS.search(piece):
            yield from (piece[i : i + _PIECE] for i in range(0, len(piece), _PIECE))
        else:
            yield piece


class Codec:
    """A byte-level vocabulary with the marks of a template as reserved ids above it."""

    def __init__(self, path: str, template: Template):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.first_reserved = max(ranks.values()) + 1
        self.reserved = {m: self.first_reserved + i for i, m in enumerate(template.marks)}
        self._encoding = tiktoken.Encoding(
            "chat", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens=self.reserved
        )
        self._encoding_of_text = self._encoding.encode_ordinary

    def encode(self, text: str) -> list[int]:
        if len(text) <= _PIECE:
            return self._encoding_of_text(text)
        return [token for piece in _pieces(text) for token in self._encoding_of_text(piece)]

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode_bytes(ids.tolist()).decode("utf-8")


@lru_cache(maxsize=4)
def codec(path: str, template: Template) -> Codec:
    """The codec of a vocabulary file; read once in each worker."""
    return Codec(path, template)


class _Block:
    """Turns of one conversation under construction."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars = conv_id, 0, 0
        self.segments: list[list[int]] = []
        self.trained: list[int] = []
        self.text: list[str] = []

    def add(self, role: str, text: str, template: Template, coder: Codec) -> None:
        role_out, text_out = template.escape(role), template.escape(text)
        pieces = [template.open, role_out, template.close, text_out, template.end]
        for i, piece in enumerate(pieces):
            if i == 3 and role in template.trained:
                self.trained.append(len(self.segments))
            self.segments.append(coder.encode(piece) if i in (1, 3) else [coder.reserved[piece]])
        self.text += pieces
        self.turns += 1
        self.chars += sum(map(len, pieces))

    def row(self, number: int) -> dict:
        ends = np.cumsum([len(s) for s in self.segments])
        ids = np.fromiter((t for s in self.segments for t in s), np.int32, int(ends[-1]))
        # +1 where a trained segment begins, -1 where it ends; the prefix sum is the mask.
        steps = np.zeros(len(ids) + 1, np.int8)
        trained = np.array(self.trained, np.int64)
        np.add.at(steps, ends[trained - 1], 1)
        np.add.at(steps, ends[trained], -1)
        return {
            "conv_id": self.conv_id,
            "block": number,
            "n_turns": self.turns,
            "ids": ids,
            "loss_mask": np.cumsum(steps[:-1], dtype=np.int8),
            "formatted": "".join(self.text),
        }


def format_chats(
    turns: DataFrame,
    *,
    tokenizer: str = TOKENIZER,
    template: Template = Template(),
    block_chars: int = _BLOCK_CHARS,
) -> DataFrame:
    """Conversations as token ids, loss mask and rendered text.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. A conversation is one row, or
    if longer than ``block_chars`` several, whose ``block`` numbers rise and which are to
    be put one after the other; a turn is never cut. Rows of equal ``turn`` are ordered by
    role and then a hash of the text; NULL turns come first. NULL roles and texts are
    empty; rows without a conversation id form one conversation. Repeated rows are turns
    like others. Other columns are ignored; no rows give no rows.
    """
    ship_package(turns.sparkSession)
    own = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "h"]
    # Ranges follow the order of turns, so a long conversation takes several tasks.
    placed = own.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h", "turn")
    id_type = pa.int64() if dict(own.dtypes)["conv_id"] == "bigint" else pa.string()
    schema = pa.schema(
        [
            ("conv_id", id_type),
            ("block", pa.int64()),
            ("n_turns", pa.int64()),
            ("ids", pa.list_(pa.int32())),
            ("loss_mask", pa.list_(pa.int8())),
            ("formatted", pa.string()),
        ]
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer, template)
        number = TaskContext.get().partitionId() << 40
        block, ready, size = None, [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns):
                if block and (block.conv_id != conv_id or block.chars >= block_chars):
                    ready.append(block.row(number))
                    number, size, block = number + 1, size + block.chars, None
                    if size >= block_chars:
                        yield pa.RecordBatch.from_pylist(ready, schema)
                        ready, size = [], 0
                block = block or _Block(conv_id)
                block.add(role, text, template, coder)
        if block:
            ready.append(block.row(number))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    kind = dict(own.dtypes)["conv_id"] if id_type == pa.int64() else "string"
    own_id = placed if kind == "bigint" else placed.withColumn("conv_id", F.col("conv_id").cast("string"))
    return own_id.mapInArrow(
        assemble,
        f"conv_id {kind}, block long, n_turns long, ids array<int>, loss_mask array<tinyint>, formatted string",
    )


def read_turns(ids: np.ndarray, coder: Codec, template: Template) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, from token ids alone."""
    at = np.flatnonzero(ids >= coder.first_reserved)
    marks = [coder.reserved[m] for m in (template.open, template.close, template.end)]
    if len(at) % 3 or not np.array_equal(ids[at], np.tile(marks, len(at) // 3)):
        raise ValueError("token ids do not follow the template")
    for begin, middle, end in at.reshape(-1, 3):
        role, text = ids[begin + 1 : middle], ids[middle + 1 : end]
        yield template.unescape(coder.decode(role)), template.unescape(coder.decode(text))


def read_loss(ids: np.ndarray, mask: np.ndarray, coder: Codec, template: Template) -> Iterator[str]:
    """The texts under the loss mask."""
    steps = np.diff(mask, prepend=0, append=0)
    for begin, end in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
        yield template.unescape(coder.decode(ids[begin:end]))


def chat_digests(
    formatted: DataFrame, *, tokenizer: str = TOKENIZER, template: Template = Template()
) -> DataFrame:
    """Counts and digests per conversation, read back from the token ids and masks.

    A digest runs over the turns in order, so one task streams each conversation, block by
    block; it holds one block and two hash states.
    """
    import hashlib

    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_type = pa.int64() if kind == "bigint" else pa.string()
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer, template)
        done, state, current = [], None, None

        def close():
            n, turns, chars, loss, size = state
            done.append(dict(zip(names, [current, n, turns.hexdigest(), chars, loss.hexdigest(), size])))

        for batch in batches:
            for i in range(batch.num_rows):
                conv_id = batch.column("conv_id")[i].as_py()
                if state is None or conv_id != current:
                    if state:
                        close()
                    state, current = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv_id
                ids = batch.column("ids")[i].values.to_numpy()
                mask = batch.column("loss_mask")[i].values.to_numpy()
                for role, text in read_turns(ids, coder, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in read_loss(ids, mask, coder, template):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(coder.decode(ids))
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if state:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    blocks = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return blocks.select("conv_id", "ids", "loss_mask").mapInArrow(
        digest,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )
