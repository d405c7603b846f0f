"""WARC archives as a Spark data source, payloads as chunk rows.

A record is any number of rows of record id and chunk number, each with a piece of the
payload, so no task holds a whole payload while it writes or reads an archive. Digests
run along: every row that is read carries the SHA-1 of the payload up to its end, the last
one that of the whole. Files hold one gzip member a record. A task writes files of its own
names; the commit lists those of finished tasks, and only they are read, so lost or
repeated tasks leave nothing behind that counts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from logspark.llm.tables import staged
from logspark.session import ship_package
from logspark.sources.files import locate

CHUNK = 1 << 16
# A task starts a new file when one is this large, so that reading stays parallel.
FILE_BYTES = 256 << 20
_MANIFEST = "_committed.json"
_BATCH_BYTES = 4 << 20

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, chunk_no long, last boolean, data binary, bytes_so_far long, digest_so_far string"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("chunk_no", pa.int64()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
    ]
)
# Kind of revisit: the payload is that of the record referred to (value of the standard).
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _field(name: str, value: str | None) -> str:
    """A header line; control characters and blanks at its ends cannot break it."""
    if value is None:
        return ""
    safe = re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", value)
    return f"{name}: {safe}\r\n"


def _head(row: dict, date: str) -> bytes:
    """WARC and HTTP header of a record, up to its payload."""
    size = row["payload_bytes"]
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    )
    revisit = row["record_type"] == "revisit"
    lines = (
        "WARC/1.1\r\n"
        + _field("WARC-Type", row["record_type"])
        + _field("WARC-Record-ID", f"<{row['record_id']}>")
        + _field("WARC-Date", date)
        + _field("WARC-Target-URI", row["target_uri"])
        + _field("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")
        + (_field("WARC-Profile", _SAME_PAYLOAD) + _field("WARC-Refers-To", f"<{row['refers_to']}>") if revisit else "")
        + _field("Content-Type", "application/http; msgtype=response")
        + _field("Content-Length", str(len(http) + (0 if revisit else size)))
    )
    return (lines + "\r\n" + http).encode("utf-8", "surrogatepass")


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.date = options["date"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        system, inner = locate(self.path)
        system.create_dir(inner, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = locate(self.path)
        files, out, packer = [], None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None or out.tell() >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{inner}/{files[-1]}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(row, self.date)))
                out.write(packer.compress(row["data"] or b""))
                if row["last"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, inner = locate(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{inner}/{_MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        system, inner = locate(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{inner}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.chunk = int(options.get("chunk_bytes", CHUNK))
        self.with_data = options.get("data", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        system, inner = locate(self.path)
        with system.open_input_stream(f"{inner}/{_MANIFEST}") as lines:
            files = json.loads(lines.read())
        return [InputPartition(name) for name in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, inner = locate(self.path)
        rows, size = [], 0
        with system.open_input_file(f"{inner}/{partition.value}") as packed:
            for row in read_records(gzip.GzipFile(fileobj=packed), self.chunk):
                size += 500 + len(row["data"])
                rows.append(row if self.with_data else row | {"data": None})
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _headers(stream, first: bytes | None = None) -> dict[str, str]:
    found = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        found[name.decode().strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return found


def read_records(raw, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an uncompressed stream of records, holding one chunk at a time."""
    stream = io.BufferedReader(raw, 1 << 16)
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(stream)
        left = int(head["content-length"])
        size = None
        if head.get("content-type", "").startswith("application/http"):
            block = io.BytesIO()
            while (line := stream.readline()) not in (b"\r\n", b""):
                block.write(line)
            left -= block.tell() + len(line)
            block.seek(0)
            block.readline()
            size = int(_headers(block).get("content-length", left))
        row = {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": head["warc-type"],
            "target_uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": left if size is None else size,
        }
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise EOFError("the archive ends inside a record")
            left -= len(data)
            done += len(data)
            digest.update(data)
            so_far = {"bytes_so_far": done, "digest_so_far": _base32(digest.digest())}
            yield row | so_far | {"chunk_no": number, "last": not left, "data": data}
            number += 1
            if not left:
                break


class WarcSource(DataSource):
    """``format("warc")``: rows of ``SCHEMA``, read from and written to a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(WarcSource)


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_revisit_bytes: int = 0,
    chunk_bytes: int = CHUNK,
    date: str | None = None,
) -> None:
    """Write one record for each row to archives in the new folder ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the
    least id (NULL last; of repeated ids that with the least url) is a response, the others
    are revisits that refer to it and have no payload; smaller ones are all responses. A
    NULL payload is an empty one. Other columns are ignored; no rows make no archive.
    """
    _register(pages.sparkSession)
    content = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), content.alias("payload"))
    same = F.sha2("payload", 256)
    light = staged(
        own.select("id", "url", same.alias("same"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")),
        "payloads",
    )
    # Tells repeated rows apart; ids hardly repeat, so the groups are small.
    nth = F.row_number().over(Window.partitionBy("id", "same").orderBy("url")) - 1
    numbered = staged(light.withColumn("nth", nth), "records")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "url", "nth")
    first = staged(numbered.groupBy("same").agg(F.min(place).alias("first")), "first")
    name = F.concat_ws(":", F.lit("urn:x-page"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.substring("same", 1, 16), "nth")
    original = F.concat_ws(
        ":", F.lit("urn:x-page"), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.substring("same", 1, 16), "first.nth"
    )
    revisit = (place != F.col("first")) & (F.col("size") >= min_revisit_bytes)
    records = numbered.join(first, "same").select(
        "same",
        name.alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, original).alias("refers_to"),
        F.col("sha1").alias("hex"),
        F.col("size").cast("long").alias("payload_bytes"),
    )
    records = staged(records, "typed")
    each = own.select(same.alias("same"), "payload").groupBy("same").agg(F.first("payload").alias("payload"))
    responses = records.where("record_type = 'response'").join(each, "same")
    revisits = records.where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / chunk_bytes).cast("int")))
    chunks = responses.unionByName(revisits).select("*", F.posexplode(starts).alias("chunk_no", "n"))
    rows = chunks.select(
        "record_id", "record_type", "target_uri", "refers_to",
        _hex_to_base32(F.col("hex")).alias("payload_digest"),
        "payload_bytes",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        ((F.col("chunk_no") + 1) * chunk_bytes >= size).alias("last"),
        F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, chunk_bytes).alias("data"),
        F.lit(None).cast("long").alias("bytes_so_far"),
        F.lit(None).cast("string").alias("digest_so_far"),
    )
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows.write.format("warc").mode("append").option("date", stamp).save(path)


def _hex_to_base32(digits: Column) -> Column:
    """A SHA-1 in hex as base32: five bits a character."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(digits, i + 1, 10), 16, 2), 40, "0") for i in range(0, 40, 10)])
    return F.concat(
        *[F.substring(F.lit(alphabet), F.conv(F.substring(bits, i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(0, 160, 5)]
    )


def read_archives(spark: SparkSession, path: str, *, data: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunk rows (``SCHEMA``) of all archives that were committed to ``path``."""
    _register(spark)
    options = {"data": str(data).lower(), "chunk_bytes": str(chunk_bytes)}
    return spark.read.format("warc").options(**options).load(path)


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Size and digest of a response are those of the payload as read; a revisit has none, so
    they are those its header states.
    """
    ends = chunks.where("last")
    response = F.col("record_type") == "response"
    number = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    return ends.select(
        number("record_id").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
