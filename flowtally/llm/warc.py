"""WARC archives as a chunked record table.

A record's payload travels as rows ``(record id, chunk number, data)`` of
bounded size, in the writer and in the reader, each with the digest so far, so
neither holds a whole payload beyond the row that Spark gave it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut, new_folder
from flowtally.llm.base import query, table

CHUNK = 1 << 20
# bytes read from an archive at once; small, as the rest of a piece is handed on at each member's end
PIECE = 1 << 15
# a header block longer than this is not a WARC header
MAX_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def chunk_rows(records: DataFrame, payload_col: str = "payload", size: int = CHUNK) -> DataFrame:
    """A row per chunk of the payload: the other columns, ``chunk_no``, ``n_chunks`` and ``data``.

    NULL counts as empty; an empty payload is one empty chunk.  The chunks of
    a record are neighbours in order, as they come from one row.
    """
    keep = [c for c in records.columns if c not in (payload_col, "chunk_no", "n_chunks", "data")]
    whole = F.coalesce(F.col(payload_col), F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length(whole) / size), F.lit(1)).cast("int")
    rows = records.select(*keep, whole.alias("_p"), n.alias("n_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(*keep, "chunk_no", "n_chunks", F.substring("_p", F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000) -> DataFrame:
    """A record per row: ``id, url, n_bytes, digest, record_type, refers_to, payload``.

    Among payloads of ``least`` bytes or more with equal SHA-1 and length, rows
    with the largest id are responses (all of them if ids repeat) and the
    others revisit it, without a payload.  NULL text is an empty payload, a
    NULL id is smaller than any other.  Equal payloads are counted before the
    join, so only digests that repeat are on its other side; a payload that a
    third of all rows share makes a skewed join, which AQE splits.
    """
    payload = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    large = p.where(F.col("n_bytes") >= least)
    same = large.groupBy(F.col("digest").alias("_d"), F.col("n_bytes").alias("_n")).agg(F.max("id").alias("first"), F.count("*").alias("n"))
    same = same.where("n > 1").drop("n")
    joined = p.join(same, (F.col("digest") == F.col("_d")) & (F.col("n_bytes") == F.col("_n")), "left")
    again = F.col("_d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        "id",
        "url",
        "n_bytes",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _urn(record_id) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def _header(row: dict, date: str) -> bytes:
    """Record header and HTTP header; line breaks in a URL are escaped, as they would end the field."""
    http = HTTP.format(row["n_bytes"]).encode()
    again = row["record_type"] == "revisit"
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['id'])}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {url}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}",
        # an extension field: a revisit's own block has no payload to measure
        f"X-Payload-Length: {row['n_bytes']}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}"] if again else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if again else row['n_bytes'])}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write the chunk rows of ``plan_records`` as one archive per task, a gzip member per record.

    Returns the manifest ``(path, records)``, which is checkpointed: a file
    belongs to the result only if the attempt that wrote it succeeded, so
    retried and speculative tasks leave files that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, pack, records = None, None, 0
        for batch in batches:
            data = batch.column("data")
            for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                if row["chunk_no"] == 0:
                    pack, records = zlib.compressobj(level, zlib.DEFLATED, 31), records + 1
                    out.write(pack.compress(_header(row, date)))
                out.write(pack.compress(data[i].as_buffer()))
                if row["chunk_no"] == row["n_chunks"] - 1:
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})

    return cut(chunks.mapInArrow(write, "path string, records long"))


class _Stream:
    """Plain bytes of an archive, gzip members joined, with a small buffer."""

    def __init__(self, source):
        self.source, self.buffer, self.packed, self.ended = source, b"", None, False

    def _more(self) -> bool:
        """Fetch the next stretch; False at the end."""
        while True:
            if self.packed is not None and self.packed.eof and self.packed.unused_data:
                raw, self.packed = self.packed.unused_data, zlib.decompressobj(31)
            elif self.packed is not None and not self.packed.eof and self.packed.unconsumed_tail:
                raw = self.packed.unconsumed_tail
            else:
                raw = self.source.read(PIECE)
                if not raw:
                    # what the decoder still holds
                    rest = self.packed.decompress(b"", CHUNK) if self.packed is not None and not self.packed.eof else b""
                    self.buffer += rest
                    return bool(rest)
                if self.packed is None and not self.ended:
                    self.ended = True
                    self.packed = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
                elif self.packed is not None and self.packed.eof:
                    self.packed = zlib.decompressobj(31)
            got = raw if self.packed is None else self.packed.decompress(raw, CHUNK)
            if got:
                self.buffer += got
                return True

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes, none only at the end."""
        while not self.buffer and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def until(self, mark: bytes) -> bytes:
        """Everything before ``mark``, which is skipped; b"" at the end."""
        while mark not in self.buffer:
            if len(self.buffer) > MAX_HEADER or not self._more():
                if self.buffer.strip():
                    raise ValueError("archive ends or goes on inside a header")
                return b""
        out, _, self.buffer = self.buffer.partition(mark)
        return out


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC header: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _records(stream: _Stream, chunk: int, with_data: bool) -> Iterator[dict]:
    while block := stream.until(b"\r\n\r\n"):
        f = _fields(block.lstrip(b"\r\n"))
        left = int(f["content-length"])
        row = {"record_id": f.get("warc-record-id"), "record_type": f.get("warc-type"), "url": f.get("warc-target-uri")}
        row["refers_to"] = f.get("warc-refers-to")
        label, _, text = f.get("warc-payload-digest", "").partition(":")
        row["header_digest"] = base64.b32decode(text).hex() if label == "sha1" else None
        row["header_bytes"] = int(f["x-payload-length"]) if "x-payload-length" in f else None
        if "application/http" in f.get("content-type", ""):
            left -= len(stream.until(b"\r\n\r\n")) + 4
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            data = bytearray()
            while left and len(data) < chunk:
                part = stream.read(min(left, chunk - len(data)))
                if not part:
                    raise ValueError("archive ends inside a record")
                data += part
                left -= len(part)
            digest.update(data)
            done += len(data)
            state = {"chunk_no": number, "last": not left, "bytes_so_far": done, "sha1_so_far": digest.copy().hexdigest()}
            yield row | state | {"data": bytes(data) if with_data else None}
            number += 1
            if not left:
                break
        # the two line ends after a record are skipped as blank space before the next header
        while stream.buffer[:2] == b"\r\n" or (len(stream.buffer) < 2 and stream._more()):
            if stream.buffer[:2] == b"\r\n":
                stream.buffer = stream.buffer[2:]
        if not stream.buffer:
            break


CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("refers_to", pa.string()),
        ("header_digest", pa.string()),
        ("header_bytes", pa.int64()),
        ("chunk_no", pa.int32()),
        ("last", pa.bool_()),
        ("bytes_so_far", pa.int64()),
        ("sha1_so_far", pa.string()),
        ("data", pa.binary()),
    ]
)


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``manifest(path)``, plain or gzip.

    A row per chunk with the payload's byte count and SHA-1 up to that chunk;
    ``last`` marks the row that has them for the whole payload.  An archive is
    streamed by one task; a row group leaves the task before the next is read.
    A cut or malformed archive fails, an empty one gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    rows, size = [], 0
                    for row in _records(_Stream(source), chunk, with_data):
                        rows.append(row)
                        size += len(row["data"] or b"") + 500
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, CHUNK_SCHEMA)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, CHUNK_SCHEMA)

    schema = "record_id string, record_type string, url string, refers_to string, header_digest string, header_bytes long, "
    schema += "chunk_no int, last boolean, bytes_so_far long, sha1_so_far string, data binary"
    return manifest.select("path").mapInArrow(read, schema)


def _id(column):
    return F.regexp_extract(column, "^<urn:record:(-?[0-9]+)>$", 1).try_cast("long")


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS first FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS digest_ok
FROM r"""


@query("op1_warc", _SQL)
def op1_warc(spark, sf_dir):
    records = plan_records(table(spark, sf_dir, "pages"))
    manifest = write_archives(chunk_rows(records), new_folder(spark, "warc"))
    read = read_archives(manifest, with_data=False).where("last")
    again = F.col("record_type") == "revisit"
    return read.select(
        _id(F.col("record_id")).alias("page_id"),
        F.when(again, F.col("header_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(again, F.col("header_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        _id(F.col("refers_to")).alias("refers_to"),
        (again | (F.col("sha1_so_far") == F.col("header_digest"))).alias("digest_ok"),
    )
