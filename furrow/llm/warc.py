"""WARC archives through a chunked record table.

Writing: each task streams its pages into one gzip-compressed WARC file, a member per record, a chunk of
the payload at a time. Reading: each task streams one file and gives a row per record and chunk with the
payload's digest and length so far, so no task holds a whole record; the last chunk's row has the
record's final figures.

Files go to the shared folder under a temporary name and get their own name only when they are whole, so
a task that runs twice leaves one file. Only files in the returned manifest are read.

Edge cases: a null payload counts as empty; rows with a null page_id are archived without one (a page
with a null page_id is the response only if all its copies have none); repeated rows with the same
page_id and payload are all responses or all revisits; a null url becomes "about:blank"; no pages make
no files and an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import fresh_path

CHUNK = 1 << 20
END = b"\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of URLs

MANIFEST_SQL = "file string, records long"
CHUNK_SQL = "file string, record_id string, chunk_no long, page_id long, url string, record_type string, refers_to long, data binary, bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"
CHUNK_SCHEMA = pa.schema(
    [
        ("file", pa.string()), ("record_id", pa.string()), ("chunk_no", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)


def base32_sha1(sha: hashlib._Hash) -> str:
    return base64.b32encode(sha.digest()).decode()


def roles(pages: DataFrame, payload: str = "html", least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with sha1 (hex) and responder: among records of equal payloads of at least `least` bytes, the largest page_id.

    A narrow aggregate finds the responders; pages then meet them by digest. Both sides of that join
    hold what a task can split, so a payload that a third of all pages share is dealt over many tasks.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(payload, F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("responder"), F.count("*").alias("copies"))
    return rows.join(first.where("copies > 1").drop("copies"), "sha1", "left")


def safe(value: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "about:blank")


def record_head(page_id: int | None, url: str | None, digest: str, size: int, responder: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda page: uuid.uuid5(NAMESPACE, f"{page} {digest}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{name(responder)}>", f"X-Refers-To-Page: {responder}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode() + END + http


def write(rows: DataFrame, path: str, level: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Archive what roles() gives in files under path; returns the manifest (one row for each file)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        held = f"{folder}/.attempt-{context.taskAttemptId()}"
        n, out = 0, None
        for batch in batches:
            columns = {k: batch.column(k) for k in ("page_id", "url", "html", "sha1", "responder")}
            for i in range(batch.num_rows):
                out = out or fs.open_output_stream(held, compression=None)
                page_id, url, hexed, responder = (columns[k][i].as_py() for k in ("page_id", "url", "sha1", "responder"))
                payload = memoryview(columns["html"][i].as_buffer() or b"")
                revisit = responder is not None and responder != page_id
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(gz.compress(record_head(page_id, url, base64.b32encode(bytes.fromhex(hexed)).decode(), len(payload), responder, revisit)))
                for at in range(0, 0 if revisit else len(payload), chunk):
                    out.write(gz.compress(payload[at : at + chunk]))
                out.write(gz.compress(END) + gz.flush())
                n += 1
        if out:
            out.close()
            fs.move(held, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return rows.select("page_id", "url", "html", "sha1", "responder").mapInArrow(task, MANIFEST_SQL)


class Member:
    """The bytes of a gzip file's members, one after the other, read as a stream."""

    def __init__(self, stream, chunk: int):
        self.stream, self.chunk = stream, chunk
        self.gz, self.raw, self.out = zlib.decompressobj(31), b"", bytearray()

    def fill(self) -> bool:
        """Adds at most a chunk of bytes; False at the file's end."""
        while True:
            if self.gz.eof:
                self.raw = self.gz.unused_data or self.raw
                self.gz = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(1 << 16)
                if not self.raw:
                    return False
            got = self.gz.decompress(self.raw, self.chunk)
            self.raw = b"" if self.gz.eof and not self.gz.unused_data else self.gz.unconsumed_tail
            if got:
                self.out += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.out.find(mark)) < 0:
            if not self.fill():
                return None
        got = bytes(self.out[: i + len(mark)])
        del self.out[: i + len(mark)]
        return got

    def some(self, most: int) -> bytes:
        while not self.out and self.fill():
            pass
        got = bytes(self.out[:most])
        del self.out[:most]
        return got


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in block.decode().split("\r\n")[1:] if ":" in x)}


def read_file(name: str, stream, chunk: int, keep_data: bool) -> Iterator[dict]:
    member = Member(stream, chunk)
    while (block := member.until(END)) is not None:
        head = headers(block)
        http = member.until(END) or b""
        left = int(head["content-length"]) - len(http)
        size = int(headers(http)["content-length"])
        revisit = head["warc-type"] == "revisit"
        row = {
            "file": name, "record_id": head["warc-record-id"], "page_id": int(head["x-page-id"]) if "x-page-id" in head else None, "url": head["warc-target-uri"],
            "record_type": head["warc-type"], "refers_to": int(head["x-refers-to-page"]) if revisit else None,
        }
        sha, so_far, chunk_no = hashlib.sha1(), 0, 0
        while True:
            data = b""
            while len(data) < chunk and so_far + len(data) < left:
                got = member.some(min(chunk - len(data), left - so_far - len(data)))
                if not got:
                    raise ValueError(f"{name} ends inside {head['warc-record-id']}")
                data += got
            sha.update(data)
            so_far += len(data)
            last = so_far >= left
            digest = base32_sha1(sha)
            if last and not revisit and (digest, so_far) != (head["warc-payload-digest"].removeprefix("sha1:"), size):
                raise ValueError(f"{name}: the payload of {head['warc-record-id']} is not what its head says")
            yield row | {
                "chunk_no": chunk_no, "data": data if keep_data else None, "bytes_so_far": so_far, "digest_so_far": digest, "last": last,
                "payload_bytes": (size if revisit else so_far) if last else None, "payload_digest": (head["warc-payload-digest"].removeprefix("sha1:") if revisit else digest) if last else None,
            }
            chunk_no += 1
            if last:
                break
        if member.until(END) != END:
            raise ValueError(f"{name}: bytes left after {head['warc-record-id']}")


def read(spark: SparkSession, files: DataFrame, chunk: int = CHUNK, keep_data: bool = True, shared: str = "") -> DataFrame:
    """The chunked record table of the manifest's files: a row for each record and chunk, the digest carried along."""
    uri = shared

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for row in read_file(name, stream, chunk, keep_data):
                        rows.append(row)
                        held += len(row["data"] or b"") + 500
                        if held >= 4 * chunk:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_SCHEMA)

    return files.select("file").mapInArrow(task, CHUNK_SQL)


def archive(pages: DataFrame, payload: str = "html", least: int = 0) -> tuple[str, DataFrame]:
    """Write pages as WARC files under the shared folder; the folder and the manifest, read back one file a task."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    listed = write(roles(pages, payload, least), f"{path}/files")
    listed.write.parquet(f"{path}/manifest")
    files = spark.read.schema(listed.schema).parquet(f"{path}/manifest")
    n = max(1, files.count())
    return f"{path}/files", files.repartition(n, "file")


def records(pages: DataFrame, payload: str = "html", least: int = 0) -> DataFrame:
    """Archive, read back, and give each record's last chunk row: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path, files = archive(pages, payload, least)
    chunks = read(pages.sparkSession, files, keep_data=False, shared=path)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
