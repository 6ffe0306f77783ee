from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from flowtally.lineage import new_folder
from flowtally.llm import warc
from flowtally.llm.warc import chunk_rows, op1_warc, plan_records, read_archives, write_archives

SMALL = "/root/testdata/sf0.001"


def archive(spark, df, size=warc.CHUNK, **options):
    return read_archives(write_archives(chunk_rows(plan_records(df), size=size), new_folder(spark, "warc")), **options)


def test_query_equals_pages(spark):
    rows = {r.page_id: r for r in op1_warc(spark, SMALL).collect()}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert rows.keys() == pages.keys()
    first = {}
    for i, p in pages.items():
        first[p] = max(i, first.get(p, i))
    for i, p in pages.items():
        again = len(p) >= 1000 and first[p] != i
        expected = (len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first[p] if again else None, True)
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) == expected


BIG = "".join(chr(97 + i * i % 26) for i in range(5000)) * 700
PAGES = [
    (1, "u\nv: w", BIG),
    (2, None, BIG),
    (5, "a", "y" * 1000),
    (7, "a", "y" * 1000),
    (7, "b", "y" * 1000),
    (3, "b", None),
    (4, "b", ""),
    (None, "c", "y" * 1000),
    (8, "q", "y" * 999),
    (9, "q", "y" * 999),
    (10, "r", "WARC/1.1\r\n\r\n\r\nWARC-Type: x\r\n\r\n"),
]


def test_edges_and_chunks(spark):
    df = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, data string, chunk_no int")
    got = archive(spark, df, size=1 << 19).collect()
    last = sorted(((r.record_id, r.record_type, r.refers_to, r.bytes_so_far) for r in got if r.last), key=str)
    urn = "<urn:record:{}>".format
    assert last == sorted(
        [
            (urn(1), "revisit", urn(2), 0),
            (urn(2), "response", None, len(BIG)),
            (urn(5), "revisit", urn(7), 0),
            (urn(7), "response", None, 1000),
            (urn(7), "response", None, 1000),
            (urn(3), "response", None, 0),
            (urn(4), "response", None, 0),
            (urn(""), "revisit", urn(7), 0),
            (urn(8), "response", None, 999),
            (urn(9), "response", None, 999),
            (urn(10), "response", None, len(PAGES[-1][2])),
        ],
        key=str,
    )
    chunks = sorted((r for r in got if r.record_id == urn(2)), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in chunks] == [0, 1, 2, 3] and all(len(r.data) <= warc.CHUNK for r in chunks)
    seen = b""
    for r in chunks:
        seen += bytes(r.data)
        assert r.sha1_so_far == hashlib.sha1(seen).hexdigest() and r.bytes_so_far == len(seen)
    assert seen == BIG.encode()
    assert {r.url for r in got if r.record_id == urn(1)} == {"u%0Av:%20w"}


def test_header_digest_of_a_revisit_is_that_of_its_payload(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for r in archive(spark, df, with_data=False).where("record_type = 'revisit' AND last").collect():
        payload = BIG if r.header_bytes == len(BIG) else "y" * 1000
        assert (r.header_digest, r.header_bytes) == (hashlib.sha1(payload.encode()).hexdigest(), len(payload))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive(spark, df).collect() == []


def record(payload, extra=b"", kind=b"resource"):
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\n"
    return head + extra + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_foreign_archives_plain_or_gzip(pack):
    payloads = [b"", b"a\r\n\r\nb", bytes(range(256)) * 9000, b"\r\n\r\n"]
    data = b"".join(pack(record(p)) for p in payloads)
    got = [(r["bytes_so_far"], r["sha1_so_far"] == r["header_digest"]) for r in warc._records(warc._Stream(io.BytesIO(data)), 1 << 20, True) if r["last"]]
    assert got == [(len(p), True) for p in payloads]


def test_cut_archive_fails():
    data = record(b"x" * 100)[:-60]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc._records(warc._Stream(io.BytesIO(data)), 1 << 20, True))
    with pytest.raises(ValueError, match="no WARC header"):
        list(warc._records(warc._Stream(io.BytesIO(b"hello\r\n\r\n")), 1 << 20, True))
