import io
import lzma
import random

import pytest
from pyspark.sql import functions as F

from logspark.plans.combine import combine_logs
from logspark.sources import xz_blocks
from logspark.sources.archives import complete_files, read_streamed
from logspark.sources.lines import FileSelection
from samples import line


def of_blocks(parts):
    """One xz file of a block for each part: streams of one block joined without their ends.

    The index and footer are put together here, as the standard library writes one block a stream.
    """
    import struct
    import zlib

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    blocks, records, header = [], [], b""
    for part in parts:
        whole = lzma.compress(part)
        (block,) = xz_blocks.blocks_of(io.BytesIO(whole), len(whole))
        _, ((size, length),), header = xz_blocks._stream_before(io.BytesIO(whole), len(whole))
        blocks.append(whole[block.start : block.start + block.size])
        records.append(number(size) + number(length))
    index = b"\0" + number(len(records)) + b"".join(records)
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + header[6:8]
    return header + b"".join(blocks) + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"


def random_text(rng, size):
    return bytes(rng.choice(b"ab\n") if rng.random() < 0.9 else rng.randrange(256) for _ in range(size))


@pytest.mark.parametrize("seed", range(30))
def test_pieces_give_every_line_once(seed):
    rng = random.Random(seed)
    text = random_text(rng, rng.randrange(400)) if seed else b"\n\nabc"
    cuts = sorted(rng.randrange(1, len(text) + 1) for _ in range(rng.randrange(8))) if text else []
    parts = [p for p in (text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)) if p] or [b"x"]
    text = b"".join(parts)
    packed = of_blocks(parts)
    assert lzma.decompress(packed) == text
    if rng.random() < 0.5:  # several streams with padding
        packed, text = packed + bytes(8) + of_blocks(parts[::-1]), text + b"".join(parts[::-1])
    raw = io.BytesIO(packed)
    blocks = xz_blocks.blocks_of(raw, len(packed))
    assert sum(b.length for b in blocks) == len(text)
    want, at = [], 0
    for row in text.split(b"\n"):
        if row:
            want.append((at, row))
        at += len(row) + 1
    for piece_bytes in (1, 50, 10**6):
        got = [x for a, b in xz_blocks.pieces(blocks, piece_bytes) for found in xz_blocks.lines_of(raw, blocks, a, b) for x in found]
        assert got == want


def entries(n, block):
    rows = [line(i, f"source-{i % 3}").encode() + b"\n" for i in range(n)]
    return [b"".join(rows[i : i + block]) for i in range(0, n, block)]


def test_fifty_blocks_are_fifty_tasks(spark, tmp_path):
    parts = entries(5000, 100)
    whole = b"".join(parts)
    step = len(whole) // 50 + 1
    (tmp_path / "a.log.xz").write_bytes(of_blocks([whole[i : i + step] for i in range(0, len(whole), step)]))
    (tmp_path / "b.xz").write_bytes(lzma.compress(parts[0]))
    lines = read_streamed(spark, str(tmp_path), piece_bytes=1000)
    got = [(r.file.rpartition("/")[2], r.value) for r in lines.collect()]
    want = [("a.log.xz", x) for x in whole.decode().splitlines()] + [("b.xz", x) for x in parts[0].decode().splitlines()]
    assert sorted(got) == sorted(want)
    used = lines.where(F.endswith("file", F.lit("a.log.xz"))).select(F.spark_partition_id().alias("p"))
    assert used.distinct().count() >= 30  # dealt out at random over 50
    assert used.agg(F.count_distinct("p")).first()[0] <= 50


@pytest.mark.parametrize("where", ["block", "index", "end"])
def test_damage_drops_the_file(spark, tmp_path, where):
    parts = entries(1000, 100)
    packed = bytearray(of_blocks(parts))
    if where == "block":
        packed[len(packed) // 2] ^= 0x55
    elif where == "index":
        packed[-30] ^= 0x55
    else:
        del packed[-200:]
    (tmp_path / "a.log.xz").write_bytes(bytes(packed))
    (tmp_path / "b.log.xz").write_bytes(of_blocks(parts[:3]))
    lines = read_streamed(spark, str(tmp_path), piece_bytes=100)
    assert lines.where("read_error is not null").count() >= 1
    kept = complete_files(lines)
    assert {r.file.rpartition("/")[2]: r["count"] for r in kept.groupBy("file").count().collect()} == {"b.log.xz": 300}
    with pytest.raises(Exception):
        read_streamed(spark, str(tmp_path), piece_bytes=100, on_file_error="fail").collect()


def test_whole_job(spark, tmp_path):
    parts = entries(300, 30)
    (tmp_path / "a.log.xz").write_bytes(of_blocks(parts))
    assert combine_logs(spark, str(tmp_path), selection=FileSelection(all_files=True)).count() == 300
