"""Blocks of xz files, so that one file can be read by many tasks.

An xz file ends with an index of its blocks, each of which can be decompressed by itself. A
task that reads some of them keeps the lines that begin behind the first newline of its
first block, and goes on into the next blocks to the end of its last line.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

# Fixed values of the file format.
_HEADER_MAGIC, _FOOTER_MAGIC = b"\xfd7zXZ\x00", b"YZ"
_HEADER_SIZE = 12
CHUNK = 1 << 20


class Block(NamedTuple):
    """Where a block stands: in the file, in the decompressed text, and its stream's header."""

    start: int
    size: int
    at: int
    length: int
    header: bytes


def _padded(size: int) -> int:
    return -(-size // 4) * 4


def _exactly(raw, start: int, size: int) -> bytes:
    raw.seek(start)
    data = raw.read(size)
    if len(data) != size:
        raise EOFError("unexpected end of data")
    return data


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, lowest first, and where the next one begins."""
    value = 0
    for n, byte in enumerate(data[at : at + 9]):
        value |= (byte & 127) << 7 * n
        if byte < 128:
            return value, at + n + 1
    raise lzma.LZMAError("broken index")


def _stream_before(raw, end: int) -> tuple[int, list[tuple[int, int]], bytes]:
    """Start, (size, length) of the blocks, and header of the stream that ends at ``end``."""
    footer = _exactly(raw, end - _HEADER_SIZE, _HEADER_SIZE)
    crc, backward = struct.unpack("<II", footer[:8])
    if footer[10:] != _FOOTER_MAGIC or zlib.crc32(footer[4:10]) != crc:
        raise lzma.LZMAError("broken stream footer")
    index_size = 4 * (backward + 1)
    index_start = end - _HEADER_SIZE - index_size
    if index_start < _HEADER_SIZE:
        raise lzma.LZMAError("broken stream footer")
    index = _exactly(raw, index_start, index_size)
    if index[0] or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
        raise lzma.LZMAError("broken index")
    count, at = _number(index, 1)
    sizes = []
    for _ in range(count):
        size, at = _number(index, at)
        length, at = _number(index, at)
        sizes.append((size, length))
    start = index_start - sum(_padded(size) for size, _ in sizes) - _HEADER_SIZE
    if start < 0:
        raise lzma.LZMAError("broken index")
    header = _exactly(raw, start, _HEADER_SIZE)
    if header[:6] != _HEADER_MAGIC or header[6:8] != footer[8:10]:
        raise lzma.LZMAError("broken stream header")
    return start, sizes, header


def blocks_of(raw, size: int) -> list[Block]:
    """All blocks of a file with one or several streams, from the indexes alone."""
    streams, end = [], size
    while end > 0:
        while end >= 4 and _exactly(raw, end - 4, 4) == bytes(4):  # padding between streams
            end -= 4
        if end < 2 * _HEADER_SIZE:
            raise lzma.LZMAError("no xz stream")
        end, sizes, header = _stream_before(raw, end)
        streams.append((end, sizes, header))
    found, at = [], 0
    for start, sizes, header in reversed(streams):
        place = start + _HEADER_SIZE
        for size, length in sizes:
            found.append(Block(place, _padded(size), at, length, header))
            place, at = place + _padded(size), at + length
    return found


def pieces(blocks: list[Block], piece_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of blocks (first, past the last) of at least ``piece_bytes`` of text, but for the last."""
    first, held = 0, 0
    for n, block in enumerate(blocks):
        held += block.length
        if held >= piece_bytes:
            yield first, n + 1
            first, held = n + 1, 0
    if first < len(blocks):
        yield first, len(blocks)


def _text(raw, blocks: list[Block]) -> Iterator[bytes]:
    """Decompressed text of blocks, in chunks; each block's own check sum is verified."""
    for block in blocks:
        decompressor = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        made = len(decompressor.decompress(block.header))
        at, end = block.start, block.start + block.size
        while at < end or (made < block.length and not decompressor.needs_input):
            data = b""
            if decompressor.needs_input:
                data = _exactly(raw, at, min(CHUNK, end - at))
                at += len(data)
            text = decompressor.decompress(data, CHUNK)
            made += len(text)
            if text:
                yield text
            elif not data and not decompressor.needs_input:
                break
        if made != block.length:
            raise lzma.LZMAError("block of another length than its index says")


def lines_of(raw, blocks: list[Block], first: int, last: int) -> Iterator[list[tuple[int, bytes]]]:
    """Non-empty lines, with their offset in the text, of the blocks from ``first`` to before ``last``.

    A line belongs to the blocks in which the newline before it lies; the first blocks
    have the first line as well.
    """
    stop = blocks[last - 1].at + blocks[last - 1].length
    skipping, rest = first > 0, []
    begin = blocks[first].at  # of the line that `rest` is the start of
    for chunk in _text(raw, blocks[first:]):
        if skipping:
            skipped, newline, chunk = chunk.partition(b"\n")
            begin += len(skipped) + len(newline)
            if not newline:
                if begin >= stop:
                    return
                continue
            skipping = False
            # A line that begins just behind the blocks is still theirs.
            if begin > stop:
                return
        head, newline, tail = chunk.rpartition(b"\n")
        if not newline:
            rest.append(chunk)
            continue
        found = []
        for line in (b"".join(rest) + head).split(b"\n"):
            if begin > stop:
                break
            if line:
                found.append((begin, line))
            begin += len(line) + 1
        if found:
            yield found
        if begin > stop:
            return
        rest = [tail]
    line = b"".join(rest)
    if line and begin <= stop and not skipping:
        yield [(begin, line)]
