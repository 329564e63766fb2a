"""WARC archives: an index first, then byte-range reads.

Writing: pages become WARC/1.1 records, one gzip member each, in one archive per task. Of pages with equal payloads of at least
`least_bytes` bytes the one with the smallest id is the response, the others are revisits that refer to it and carry no payload. Equal
payloads are found by digest and length; payloads move once, by id and digest, so a payload that a third of all pages share isn't a hot
key. While a task writes, it yields the index: file, offset, length, URL and digest of each record. Archives of lost or repeated attempts
have other names and are in no index.

Reading: selected index rows are dealt to tasks by ranges of file and offset, so a large archive is read by several; in a task, ranges that lie within `GAP` bytes of each other are read at once, up
to `READ` bytes; payloads are checked against their digests.

Null payloads are empty, and so is a null URL. Equal rows are all responses if they have the smallest id; pages without an id are
revisits of a page with one, or else responses. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import new_path, small_batches, written

LEAST_BYTES = 0
DATE = "2026-01-01T00:00:00Z"
GAP, READ = 64 << 10, 8 << 20
#: Bytes of archives that a task reads, about.
TASK_BYTES = 64 << 20
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def typed(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (null for revisits), n_bytes, sha1, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(payload.cast("binary")).alias("sha1")
    )
    first = rows.groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first"))
    small = F.col("n_bytes") < least_bytes
    own = rows.join(first.withColumnRenamed("n_bytes", "_n").withColumnRenamed("sha1", "_s"), (F.col("sha1") == F.col("_s")) & (F.col("n_bytes") == F.col("_n")) & F.col("page_id").eqNullSafe(F.col("first")))
    responses = own.select("page_id", "url", "payload", "n_bytes", "sha1", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    others = rows.drop("payload").join(first, ["sha1", "n_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = others.filter(~small).select("page_id", "url", F.lit(None).cast("string").alias("payload"), "n_bytes", "sha1", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    if least_bytes <= 0:
        return responses.unionByName(revisits)
    alone = rows.filter(small).select("page_id", "url", "payload", "n_bytes", "sha1", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.filter(~small).unionByName(revisits).unionByName(alone)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: str | None, n_bytes: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP head alone."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to)), ("X-Payload-Length", str(n_bytes))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or "").encode()
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes archives into `folder` (any place that pyarrow's file systems reach) and returns the index as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, offset = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in small_batches(batches, rows=200):
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(name, compression=None)
            rows = []
            for page_id, url, payload, n, sha1, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = gzip.compress(record(page_id, url, payload, n, digest, kind, refers), 1, mtime=0)
                out.write(data)
                rows.append((name, offset, len(data), url, digest, page_id, kind))
                offset += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return written(typed(pages, least_bytes).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, by coalesced range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        opened: tuple[str, pa.NativeFile] | None = None

        def records(file: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened
            if opened is None or opened[0] != file:
                if opened:
                    opened[1].close()
                opened = file, store.open_input_file(file)
            start = run[0][0]
            data = opened[1].read_at(run[-1][0] + run[-1][1] - start, start)
            out = []
            for offset, length in run:
                headers, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload at {file}:{offset} doesn't match its digest")
                number = lambda name: int(headers[name]) if name in headers else None
                out.append((number("x-page-id"), headers["warc-target-uri"], len(payload) if kind == "response" else number("x-payload-length"), digest, kind, number("x-refers-to-page-id"), payload if payloads and kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RECORDS.split(", ")])

        file, waiting = "", []
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                end = waiting[-1][0] + waiting[-1][1] if waiting else 0
                if waiting and (name != file or offset - end > GAP or offset + length - waiting[0][0] > READ):
                    yield records(file, waiting)
                    waiting = []
                file = name
                waiting.append((offset, length))
        if waiting:
            yield records(file, waiting)
        if opened:
            opened[1].close()

    wanted = index.select("file", "offset", "length")
    size = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    wanted = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, RECORDS)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The report in DuckDB SQL: SHA-1 in base 32 is taken from its hex form, 20 bits at a time.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(g AS INTEGER) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) % 32 AS INTEGER) + 1, 1)), '')), '') AS digest,
    min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d
"""
