"""WARC archives written from and read into tables, payloads in chunks.

Writing streams every payload to its archive in slices; each record is a gzip
member of its own, archives roll at a set size, and a task's archives count only
once they are in the manifest, which Spark commits: a repeated attempt writes
other files and the first ones are never read.

Reading gives a chunk table: a row per record and chunk number with the bytes,
their offset and the SHA-1 of the payload so far. No record is ever whole in
memory, whatever its size; a payload's digest is that of its last chunk.

Defined cases: a null payload is empty, a null URL leaves out the header, a null
id is written as an empty one and read back as null. Repeated rows are written as
often as they come; of equal payloads all rows with the largest id are responses.
An empty table writes no archive and reads back as no rows. Other columns of the
input are ignored.

Malformed archives are read as far as they go; a record with a fault has an ``error`` among its
headers. An HTTP block without a blank line in its first MB has no HTTP headers and is payload as a
whole. A record without a usable Content-Length goes on until the next one begins. One that the archive
ends in has the bytes that are there. What begins like no record at all ends the archive with one
empty row.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.cluster import materialize, shared_dir

#: Payloads below this are always written in full: a revisit would save nothing.
LEAST_REVISIT = 1000
CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 64 << 20
#: Bytes in which a header must end, and how the next record begins.
HEAD_BYTES, _NEXT = 1 << 20, b"\r\n\r\nWARC/"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
CHUNKS = "path string, record_no bigint, record_id string, record_type string, headers map<string,string>, chunk_no bigint, offset bigint, data binary, sha1 string, last boolean"


def payload_sha1(html: str = "html") -> Column:
    return F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary"))


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Adds digest, size, and for rows whose payload is repeated the id that has it in full.

    Only payloads that occur twice become referents, and these are written first: where they
    are few enough to broadcast, no payload moves. Otherwise the join's keys may be hot (many
    copies of one payload): both sides are plain exchanges, so adaptive execution
    splits them; small payloads get keys of their own and never meet.
    """
    size = F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).cast("long")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), payload_sha1(html_col).alias("digest"), size.alias("n"))
    again = d.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("full_id"), F.count("*").alias("rows")).where("rows > 1")
    again = materialize(again.select(F.col("digest").alias("key"), "full_id"), "repeats")
    key = F.when(F.col("n") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    out = d.withColumn("key", key).join(again, "key", "left").drop("key")
    revisit = F.col("full_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("full_id"), F.lit(False))
    return out.withColumn("refers_to", F.when(revisit, F.col("full_id"))).drop("full_id")


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> tuple[bytes, bytes]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}", "", ""]
    return "\r\n".join(lines).encode(), http


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the rows of mark_revisits() as gzipped archives below ``folder`` (a URI
    that executors share) and returns the manifest of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, path, records = None, "", 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [records], "n_bytes": [size]})

        for batch in batches:
            html = batch.column("html").cast(pa.large_binary())
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "n", "refers_to")), strict=True)
            for i, (page_id, url, digest, size, refers_to) in enumerate(rows):
                if out is None:
                    path, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                head, http = _head(page_id, url, digest, size, refers_to)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packer.compress(head + http))
                if refers_to is None and size:
                    payload = memoryview(html[i].as_buffer())
                    for k in range(0, size, chunk_bytes):
                        out.write(packer.compress(payload[k : k + chunk_bytes]))
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                records += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(marked.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of an archive, gzipped by members or plain, with bounded buffers."""

    def __init__(self, raw, step: int = 256 << 10):
        self.raw, self.step = raw, step
        self.buffer = bytearray()
        self.packed = raw.read(step)
        self.gzip = self.packed[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        while True:
            ended = False
            if not self.packed:
                self.packed = self.raw.read(self.step)
                ended = not self.packed
            if not self.gzip:
                self.buffer += self.packed
                self.packed = b""
                return not ended
            # at the end of the file the last member may still hold bytes beyond the step
            try:
                got = self.unpack.decompress(self.packed, self.step)
            except zlib.error:  # as if the archive ended here
                self.raw, self.packed, self.gzip = io.BytesIO(), b"", False
                return False
            if ended and not got:
                return False
            self.packed = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.packed = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True

    def find(self, mark: bytes, most: int) -> int:
        """Where ``mark`` is within the next ``most`` bytes, or -1."""
        start = 0
        while (at := self.buffer.find(mark, start, most)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if len(self.buffer) >= most or not self._more():
                return -1
        return at

    def ended(self) -> bool:
        return not self.buffer and not (self._more() and self.buffer)

    def skip(self, n: int) -> None:
        del self.buffer[:n]

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left of the archive."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        self.skip(n)
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _length(fields: dict[str, str]) -> int | None:
    text = fields.get("content-length", "")
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def archive_chunks(raw, path: str, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of the chunk table for one archive."""
    stream, number = _Stream(raw), 0
    while True:
        while stream.find(b"\r\n", 2) == 0:
            stream.skip(2)
        at = stream.find(b"\r\n\r\n", HEAD_BYTES)
        if not stream.buffer:
            return
        head = bytes(stream.buffer[: max(0, at)])
        if not head.startswith(b"WARC/"):
            fault = {"error": "no record begins here" if at >= 0 else "a header doesn't end"}
            yield path, number, "", "", list(fault.items()), 0, 0, b"", hashlib.sha1().hexdigest(), True
            return
        stream.skip(at + 4)
        fields = _fields(head)
        left = _length(fields)
        if left is None:
            fields["error"] = "no usable Content-Length"
        if fields.get("content-type", "").startswith("application/http"):
            most = HEAD_BYTES if left is None else min(left, HEAD_BYTES)
            if (at := stream.find(b"\r\n\r\n", most)) >= 0:
                http = stream.take(at + 4)
                left = None if left is None else left - len(http)
                fields |= {f"http-{k}": v for k, v in _fields(http[:-4]).items()}
        digest, chunk, offset = hashlib.sha1(), 0, 0
        record = fields.get("warc-record-id", ""), fields.get("warc-type", "")
        last = False
        while not last:
            if left is None:
                end = stream.find(_NEXT, chunk_bytes + len(_NEXT))
                data = stream.take(end if end >= 0 else chunk_bytes)
                last = end >= 0 or stream.ended()
                if last and end < 0:
                    data = data.removesuffix(b"\r\n\r\n")
            else:
                wanted = min(left, chunk_bytes)
                data = stream.take(wanted)
                left -= len(data)
                if len(data) < wanted:
                    fields["error"], left = "the archive ends within the record", 0
                last = left == 0
            digest.update(data)
            yield path, number, *record, list(fields.items()) if not chunk or last else None, chunk, offset, data, digest.hexdigest(), last
            chunk, offset = chunk + 1, offset + len(data)
        number += 1


def read_chunks(paths: DataFrame, chunk_bytes: int = CHUNK_BYTES, path_col: str = "path") -> DataFrame:
    """The chunk table of the archives in ``paths`` (a manifest, or any table of URIs)."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as raw:
                    for row in archive_chunks(raw, uri, chunk_bytes):
                        rows.append(row)
                        size += len(row[7])
                        if size >= 4 << 20 or len(rows) >= 2000:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    return paths.select(F.col(path_col)).mapInArrow(read, CHUNKS)


def list_archives(spark: SparkSession, glob: str) -> DataFrame:
    """The archives that match ``glob``, without reading them."""
    return spark.read.format("binaryFile").load(glob).select("path")


def records(chunks: DataFrame) -> DataFrame:
    """A row per record from its last chunk: payload size and digest as read for full
    records, as declared for revisits, and whether a full payload has its declared digest."""
    h = lambda k: F.element_at("headers", k)
    full = F.col("record_type") != "revisit"
    declared = F.regexp_extract(h("warc-payload-digest"), "^sha1:(.*)$", 1)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return chunks.where("last").select(
        page(F.col("record_id")).alias("page_id"),
        F.when(full, F.col("offset") + F.octet_length("data")).otherwise(h("http-content-length").try_cast("long")).alias("payload_bytes"),
        F.when(full, F.col("sha1")).otherwise(declared).alias("payload_digest"),
        "record_type",
        page(h("warc-refers-to")).alias("refers_to"),
        h("warc-target-uri").alias("url"),
        (~full | (F.col("sha1") == declared)).alias("digest_ok"),
    )


def archive_pages(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Writes ``pages`` as archives, revisits for repeated payloads, and reads the records back."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(mark_revisits(pages, **names), folder)
    files = manifest.count()
    return records(read_chunks(manifest.select("path").repartition(max(1, files))))
