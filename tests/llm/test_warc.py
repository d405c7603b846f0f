import base64
import gzip
import hashlib
import io
import json
import os

import pytest

from logspark.llm.warc import page_records, read_archives, read_records, write_archives
from logspark.session import scratch_path

PAGES = [
    (3, "http://a/", "same payload"), (1, "http://b/", "same payload"), (2, None, "same payload"),
    (4, "http://c/\r\nX: y", ""), (5, "http://d/", None), (6, "http://e/", "é\r\n\r\nWARC/1.1\r\n" * 50),
    (7, "http://f/", "long payload " * 30_000), (8, "http://f/", "long payload " * 30_000),
    (9, "http://g/", "twice"), (9, "http://g/", "twice"), (None, "http://h/", "same payload"), (None, "http://i/", "alone"),
]


def brute(minimum):
    first = {}
    for i, _, html in PAGES:
        key = html or ""
        if i is not None:
            first[key] = min(i, first.get(key, i))
    rows, used = [], set()
    for i, _, html in PAGES:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        original = first.get(html or "")
        response = len(body) < minimum or (i == original and (html or "") not in used)
        if i == original:
            used.add(html or "")
        rows.append((i, len(body), digest, "response" if response else "revisit", None if response else original))
    return sorted(rows, key=str)


@pytest.mark.parametrize("minimum, chunk", [(0, 1000), (0, 1 << 16), (10, 7)])
def test_round_trip(spark, minimum, chunk):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, same string, payload string")
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes=minimum, chunk_bytes=chunk)
    chunks = read_archives(spark, path, chunk_bytes=chunk)
    assert sorted((tuple(r) for r in page_records(chunks).collect()), key=str) == brute(minimum)
    data = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.record_id, r.chunk_no)):
        assert len(r.data) <= chunk
        if r.record_type == "response":
            data[r.record_id] = data.get(r.record_id, b"") + bytes(r.data)
    assert set(data.values()) == {(html or "").encode() for _, _, html in PAGES}


def test_files_are_gzip_members_with_standard_fields(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    write_archives(pages, path, date="2024-01-01T00:00:00Z")
    folder = path.removeprefix("file:")
    names = json.load(open(f"{folder}/_committed.json"))
    assert names and set(names) <= set(os.listdir(folder))
    raw = b"".join(gzip.open(f"{folder}/{n}").read() for n in names)
    assert raw.count(b"WARC-Record-ID: <urn:x-page:") == len(PAGES)
    records = {(r["record_id"], r["record_type"]) for r in read_records(io.BytesIO(raw))}
    assert len(records) == len(PAGES)
    assert b"WARC-Target-URI: http://c/%0D%0AX: y\r\n" in raw


def test_files_of_lost_tasks_are_not_read(spark):
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"), path)
    with open(path.removeprefix("file:") + "/stray.warc.gz", "wb") as out:
        out.write(b"half a file")
    assert read_archives(spark, path, data=False).where("last").count() == 2


def test_no_rows(spark):
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert page_records(read_archives(spark, path)).collect() == []


def test_truncated_archive_is_an_error():
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 10\r\n\r\n12345"
    with pytest.raises(EOFError):
        list(read_records(io.BytesIO(whole)))
