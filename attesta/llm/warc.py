"""WARC archives: a distributed writer, and a PySpark Python data source that reads them back.

The reader plans one partition a file (the writer bounds their size), pushes predicates on the record type and on
named headers into the scan, parses the headers of a record first and seeks over payloads that no
selected column or passed predicate needs. Records are gzip members of their own, with the skip length
of the WARC standard's annex in the member's extra field, so that a payload is skipped without inflating it;
plain files and members without a skip length are read too.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from attesta.llm.common import lean, new_path, sized, staged, table

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, target_uri string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Column -> header; these columns' predicates are decided on the headers alone.
HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "refers_to": "warc-refers-to"}
#: Bytes after which a writer starts the next file.
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """(file system, path within it) of a URI or a local path, as the workers see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(record_type: str, uri: str, record_id: str, refers_to: str | None, payload_digest: str, payload: bytes | None, payload_bytes: int) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP headers of its block and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that says its own compressed and uncompressed length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Plain:
    """A record's bytes, read from ``at`` on as far as they are asked for."""

    def __init__(self, file, at: int, lead: bytes):
        self.file, self.at, self.data = file, at, lead

    def upto(self, n: int) -> bytes:
        """At least the first ``n`` bytes, where the file has them."""
        if len(self.data) < n:
            self.data += self.file.read_at(n - len(self.data), self.at + len(self.data))
        return self.data

    def next(self, length: int) -> int:
        return self.at + length

    def find(self, mark: bytes, start: int) -> int:
        n = 2048
        while (found := self.upto(start + n).find(mark, start)) < 0:
            if len(self.data) < start + n:
                raise ValueError("a record's headers do not end")
            n *= 4
        return found


class _Zipped(_Plain):
    def __init__(self, file, at: int, lead: bytes):
        super().__init__(file, at, b"")
        self.inflate, self.rest, self.pos = zlib.decompressobj(31), lead, at + len(lead)
        self.length = None
        if lead[3] & 4:
            fields, i = lead[12 : 12 + struct.unpack_from("<H", lead, 10)[0]], 0
            while i + 4 <= len(fields):
                size = struct.unpack_from("<H", fields, i + 2)[0]
                if fields[i : i + 2] == b"sl" and size == 8:
                    self.length = struct.unpack_from("<I", fields, i + 4)[0]
                i += 4 + size

    def _step(self, most: int) -> bool:
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.file.read_at(1 << 16, self.pos)
            self.pos += len(self.rest)
        # Without more input there can still be output that an earlier limit held back.
        out = self.inflate.decompress(self.rest, most)
        moved = bool(out or self.rest)
        self.data += out
        self.rest = self.inflate.unconsumed_tail
        return moved

    def upto(self, n: int) -> bytes:
        while len(self.data) < n and self._step(n - len(self.data)):
            pass
        return self.data

    def next(self, length: int) -> int:
        if self.length is not None:
            return self.at + self.length
        while self._step(1 << 20):
            self.data = b""
        return self.pos - len(self.inflate.unused_data)


def _one_line(text: str | None) -> str:
    """A header value holds no line ends, which are percent-encoded; all other characters stay."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_id(identifier: str | None) -> int | None:
    tail = (identifier or "").rpartition(":")[2]
    return int(tail) if tail else None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` of .warc and .warc.gz files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)


class WarcReader(DataSourceReader):
    """Options: ``path``; ``payload`` "false" leaves payloads undecoded (their column is null).

    Every record is a row, those about the archive itself too. A payload is what follows the HTTP headers of
    a block that has them, else the block; a revisit has none. Headers that a record lacks are null, as is
    a missing digest; ``payload_bytes`` is the length that HTTP headers state, else that of the payload. A partition is one file, which the writer bounds. Equality and IN predicates on record type,
    target, record id and refers-to are applied to the headers before the payload is touched.
    """

    def __init__(self, options, schema: StructType):
        self.path, self.decode = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.columns = [f.name for f in schema.fields]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = HEADERS[f.attribute[0]]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = filesystem(self.path)
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))] or [_File("")]

    @staticmethod
    def _int(value: str | None) -> int | None:
        return int(value) if value and value.isdigit() else None

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        store, path = filesystem(partition.path)
        with store.open_input_file(path) as file:
            yield from self._records(file)

    def _records(self, file) -> Iterator[tuple]:
        at, end = 0, file.size()
        while at < end:
            lead = file.read_at(1 << 13, at)
            if lead[:2] == b"\r\n":  # between records
                at += 2
                continue
            found = (_Zipped if lead[:2] == b"\x1f\x8b" else _Plain)(file, at, lead)
            stop = found.find(b"\r\n\r\n", 0)
            head = dict(self._header(line) for line in found.data[:stop].decode("utf-8", "replace").split("\r\n")[1:])
            block, length = stop + 4, self._int(head.get("content-length")) or 0
            for name in ("warc-record-id", "warc-refers-to"):
                if name in head:
                    head[name] = head[name].strip("<>")
            if all(head.get(name) in values for name, values in self.wanted.items()):
                start, stated = self._payload(found, head, block, length)
                payload = None
                if self.decode and "payload" in self.columns and head.get("warc-type") != "revisit":
                    payload = bytes(found.upto(block + length)[start : block + length])
                digest_of = head.get("warc-payload-digest")
                values = {column: head.get(name) for column, name in HEADERS.items()}
                values |= {"payload_digest": digest_of and digest_of.removeprefix("sha1:"), "payload_bytes": block + length - start if stated is None else stated, "payload": payload}
                yield tuple(values[c] for c in self.columns)
            at = found.next(block + length + 4)

    def _payload(self, found: _Plain, head: dict, block: int, length: int) -> tuple[int, int | None]:
        """(where the payload begins, the length that HTTP headers state): behind the HTTP headers of a block that has them, else at its begin."""
        if not head.get("content-type", "").lower().startswith("application/http"):
            return block, None
        n = min(length, 2048)
        while (end := found.upto(block + n).find(b"\r\n\r\n", block, block + n)) < 0 and n < length:
            n = min(length, n * 4)
        end = block + length if end < 0 else end + 4
        http = dict(self._header(line) for line in found.data[block:end].decode("utf-8", "replace").rstrip("\r\n").split("\r\n")[1:])
        return end, self._int(http.get("content-length"))

    @staticmethod
    def _header(line: str) -> tuple[str, str]:
        name, _, value = line.partition(":")
        return name.strip().lower(), value.strip()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` with ``first_id``: of pages with equal payloads of ``least_bytes`` or more, the smallest id (else null).

    Payload digests are summed map-side; only digests that occur twice are joined back. They are counted
    first: few enough are broadcast, and the pages then move nowhere; more are joined by a shuffle whose hot
    digests adaptive execution deals anew.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    twice = (
        pages.where(F.col("n") >= least_bytes)
        .groupBy("digest", "n")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "n", "first_id")
    )
    twice = staged(twice, "digests")
    return pages.join(sized(twice, twice.count()), ["digest", "n"], "left").select("page_id", "url", "html", "first_id")


def write(pages: DataFrame, path: str, least_bytes: int = 0, compress: bool = True) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``; returns file, records after running.

    Null html is an empty payload, a null url an empty target; a null page_id gets an id without a
    number and never is the one that others revisit unless all are null. Repeated rows are records
    of their own; those that repeat the smallest page_id of a payload are all responses. File names hold partition and attempt; a task that
    is run again leaves only the files it reports, the others are removed before reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = filesystem(path)
        store.create_dir(folder, recursive=True)
        name, n, out, count, size, names, counts = f"part-{context.partitionId():05d}-{context.taskAttemptId()}", 0, None, 0, 0, [], []

        def finish():
            nonlocal out, count, size
            if out is not None:
                out.close()
                counts.append(count)
            out, count, size = None, 0, 0

        for batch in batches:
            for number, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    names.append(f"{name}-{n:03d}.warc.gz" if compress else f"{name}-{n:03d}.warc")
                    out, n = store.open_output_stream(f"{folder}/{names[-1]}", compression=None), n + 1
                payload = (html.as_py() or "").encode()
                number, first = number.as_py(), first.as_py()
                again = first is not None and number != first
                text = record("revisit" if again else "response", _one_line(url.as_py()), record_id(number), record_id(first) if again else None, digest(payload), None if again else payload, len(payload))
                text = member(text) if compress else text
                out.write(text)
                count, size = count + 1, size + len(text)
                if size >= FILE_BYTES:
                    finish()
        finish()
        yield pa.RecordBatch.from_pydict({"file": names, "records": counts}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return lean(deduplicated(pages, least_bytes)).select("page_id", "url", "html", "first_id").mapInArrow(run, "file string, records long")


def archive(pages: DataFrame, path: str, least_bytes: int = 0, compress: bool = True) -> None:
    """Run ``write`` and remove the files of attempts that did not finish."""
    from pyarrow import fs

    kept = {r["file"] for r in write(pages, path, least_bytes, compress).select("file").collect()}
    store, folder = filesystem(path)
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.type == fs.FileType.File and f.base_name not in kept:
            store.delete_file(f.path)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Archives go to the shared folder; rows come from the archives' headers alone."""
    path = new_path(spark, "warc")
    archive(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html"), path)
    register(spark)
    found = spark.read.format("warc").option("payload", "false").load(path)

    def number(identifier: str):
        return F.nullif(F.substring_index(identifier, ":", -1), F.lit("")).cast("long")

    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i * 5 + 1)::BIGINT, 5))::BIGINT >> s) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
