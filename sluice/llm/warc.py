"""WARC archives: writing pages with revisit records, and a sequential reader.

An archive is a run of gzip members, one per record.  The reader inflates one
member at a time from a stream of small reads, frames its block by
``Content-Length`` and checks block and payload digests, so its memory is that of
one record.  Archives lie in a folder that all executors see, under names of
their task attempt; only the names that committed attempts report are read.

Defined results: a null payload is empty; of equal payloads of ``least`` bytes or
more the row with the smallest id is a response and the rest are revisits of it
(rows that repeat that id are each a response, rows with a null id never are
referred to, and a group of them alone stays responses); line breaks in a URL are
percent-encoded in its header; every record has an id of its own, whatever page ids repeat, and a revisit names its response by page
id and target URI; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, table

ARCHIVE_BYTES = 256 << 20
#: Small, for what follows a member in the buffer is copied.
READ_BYTES = 1 << 14
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, verified boolean"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id, url, payload: bytes, refers_to, refers_url=None) -> bytes:
    """One uncompressed record.  A revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{uuid.uuid4().urn}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + header_value(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + header_value(refers_url))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, read_bytes: int = READ_BYTES):
    """The inflated gzip members of a stream, one after another."""
    inflate, parts, data = zlib.decompressobj(wbits=31), [], b""
    while data or (data := stream.read(read_bytes)):
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            data, inflate, parts = inflate.unused_data, zlib.decompressobj(wbits=31), []
        else:
            data = b""
    if any(parts):
        raise ValueError("the archive ends inside a gzip member")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    return fields, rest[:n]


def decode_record(raw: bytes) -> tuple:
    """A row of RECORD.  A broken digest raises: an archive isn't read past damage."""
    fields, block = parse_record(raw)
    if fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"block digest of {fields['warc-record-id']} differs")
    payload = block.partition(b"\r\n\r\n")[2]
    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (base32_sha1(payload) != digest or len(payload) != int(fields["x-payload-length"])):
        raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
    number = lambda k: int(fields[k]) if k in fields else None
    return (
        number("x-page-id"),
        fields.get("warc-target-uri"),
        fields["warc-type"],
        number("x-refers-to-page-id"),
        number("x-payload-length"),
        digest,
        None if revisit else payload,
        not revisit,
    )


def _writer(directory: str, archive_bytes: int):
    def write(batches):
        where, root = fs.FileSystem.from_uri(directory)
        task, made = TaskContext.get(), 0
        stem = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, rows, done = None, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    where.create_dir(root, recursive=True)
                    path = f"{stem}-{made:04d}.warc.gz"
                    out, rows, made = where.open_output_stream(path, compression=None), 0, made + 1
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(squeeze.compress(build_record(page_id, url, payload or b"", refers_to, refers_url)) + squeeze.flush())
                rows += 1
                if out.tell() >= archive_bytes:
                    done.append((path, rows, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, rows, out.tell()))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return write


def _reader(directory: str, payloads: bool):
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("verified", pa.bool_())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    def read(batches):
        where, _ = fs.FileSystem.from_uri(directory)
        for names in batches:
            for path in names.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        row = decode_record(raw)
                        rows.append(row if payloads else (*row[:6], None, row[7]))
                        held += len(raw) if payloads else 256
                        if held >= 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, refers_url``.  The winners of repeated payloads are
    counted with map-side combination and stored, so the join that follows is
    between two plain exchanges, whose skewed partitions Spark splits."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = cut(
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
        .filter("n > 1")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    seen = rows.join(repeated, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return seen.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))


def write_warc(rows: DataFrame, directory: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``page_id, url, payload, refers_to, refers_url`` and returns the manifest, a row per archive."""
    return cut(rows.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(_writer(directory, archive_bytes), MANIFEST))


def read_warc(manifest: DataFrame, directory: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` names, an archive at a time."""
    # A stated number of partitions, or adaptive execution would join the few short rows into one task.
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_reader(directory, payloads), RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = fresh_path(spark, "warc")
    manifest = write_warc(with_revisits(table(spark, sf_dir, "pages")), directory)
    return read_warc(manifest, directory, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, min(page_id) OVER (PARTITION BY t) AS first_id,
         list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
           (4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1)::BIGINT, 4)), 'string_agg', '') AS bits
  FROM p
)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + list_sum(list_transform(range(0, 5), lambda k: CASE WHEN substr(bits, 5 * i + k + 1, 1) = '1' THEN 16 >> k::INT ELSE 0 END)))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
