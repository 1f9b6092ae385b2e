"""WARC archives as a PySpark data source.

``spark.dataSource.register(WarcSource)``, then ``format("warc")`` reads and writes.  Archives are
gzip files with one member per record whose gzip header carries the public ``sl`` (skip length)
field, the member's compressed and uncompressed sizes, and a mark of the file, drawn when it is
begun.  The planner only lists files.  A reader task takes a byte range of a file, learns the mark
from the file's first bytes and finds its first member by it (an archive inside a payload has another
mark), inflates a record's headers first, tests the pushed predicates on them, and seeks past the payload
unless it is wanted: the record passed and the schema asked for ``payload``, or ``verify`` is set.

Predicates on warc_type, record_id, target_uri, payload_digest, refers_to (=, in) and on
payload_bytes (=, <, <=, >, >=) are pushed down where ``spark.sql.python.filterPushdown.enabled`` is
true.  Options: ``path`` (a file, or a folder read with those in it); ``verify`` (read the payloads of
responses and compare their digest with the header, where it is one of MD5, SHA-1, SHA-256 or SHA-512 in
hexadecimal or base 32); ``maxPartitionBytes``.  Other gzip files, with or without skip lengths, and
uncompressed archives are read by the task of their first range, record by record.

Writing takes the columns of ``SCHEMA`` by name; a task writes a file of its own below ``_attempts``
and the commit moves the files of the tasks that count, so a lost or repeated task leaves nothing
behind.  Null payloads are empty, null headers are left out, payloads of any length are written whole.
Repeated rows are records each; of equal payloads the smallest page_id is the response, and all rows of
that id.  Further columns are ignored, whatever their names.  An empty table writes no file and reads as
no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .store import Scratch

SCHEMA = "record_id string, warc_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Header of each column.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Bytes",
    "refers_to": "WARC-Refers-To",
}
#: A gzip member with an extra field of 24 bytes: the skip lengths, and the mark of its file.
MAGIC = b"\x1f\x8b\x08\x04"
FIXED = MAGIC + b"\x00\x00\x00\x00\x00\xff\x18\x00sl\x08\x00"
MARK = b"qm\x08\x00"
HEAD = len(FIXED) + 8 + len(MARK) + 8
#: Fixed value: the profile of a revisit of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shortest payload that a later record may refer back to.
LEAST_REVISIT = 100


def filesystem(path: str):
    """A pyarrow file system and the path in it; local paths need no scheme."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def member(block: bytes, mark: bytes) -> bytes:
    """A gzip member with skip lengths and the mark of its file."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    size = HEAD + len(body) + 8
    head = FIXED + struct.pack("<II", size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF) + MARK + mark
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def mark_of(head: bytes) -> bytes | None:
    """The mark in a member's first bytes, if it has one."""
    return head[HEAD - 8 : HEAD] if len(head) >= HEAD and head.startswith(FIXED) and head[HEAD - 12 : HEAD - 8] == MARK else None


def differs(payload: bytes, digest: str | None) -> bool:
    """Whether a payload has another digest than its header says; digests that cannot be read say nothing."""
    name, _, value = (digest or "").rpartition(":")
    name = (name or "sha256").lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return False
    own = hashlib.new(name, payload).digest()
    try:
        said = bytes.fromhex(value) if len(value) == 2 * len(own) else base64.b32decode(value.upper().ljust(-(-len(value) // 8) * 8, "="))
    except (ValueError, binascii.Error):
        return False
    return own != said


def record(row: dict, mark: bytes) -> bytes:
    """One record: version line, headers, payload; header values lose their line breaks."""
    payload = row.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row.get(column)
        if value is not None:
            value = " ".join(str(value).split())
            value = f"sha256:{value}" if column == "payload_digest" and ":" not in value else value
            lines.append(f"{name}: {value}")
    if row.get("warc_type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return member("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", mark)


@dataclass
class Span(InputPartition):
    """Members of a file that begin in a range of bytes."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        out, name, mark = None, f"part-{uuid.uuid4().hex}.warc.gz", uuid.uuid4().bytes[:8]
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{root}/_attempts-{self.job}", recursive=True)
                    out = fs.open_output_stream(f"{root}/_attempts-{self.job}/{name}", compression=None)
                out.write(record(row, mark))
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in _files(self.path):
                fs.delete_file(f.path)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/_attempts-{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/_attempts-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_attempts-{self.job}")


def _files(path: str) -> list:
    from pyarrow.fs import FileSelector, FileType

    fs, root = filesystem(path)
    at = fs.get_file_info(root)
    if at.type == FileType.File:
        return [at]
    if at.type == FileType.NotFound:
        return []
    hidden = lambda p: any(x.startswith(("_", ".")) for x in posixpath.relpath(p, root).split("/"))
    return [f for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and not hidden(f.path)]


#: Compares a header's value with a pushed value.
COMPARE = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"].rstrip("/")
        self.columns = [f.name for f in schema.fields]
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.size = int(options.get("maxPartitionBytes", 64 << 20))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            number = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if column in HEADERS and type(f) in COMPARE and (column == "payload_bytes" or not number):
                self.tests.append((type(f), column, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = [Span(f.path, k, min(k + self.size, f.size)) for f in _files(self.path) for k in range(0, f.size, self.size)]
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for row in self._records(partition) if partition.file else ():
            rows.append(row)
            held += len(row.get("payload") or b"") + 400
            if held > 4 << 20:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns)

    def _records(self, span: Span) -> Iterator[dict]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(span.file) as f:
            head = f.read(HEAD)
            mark = mark_of(head)
            if mark is None and span.start:
                return  # the task of the first range reads the whole file
            at = self._first(f, span, mark) if span.start else 0
            end = span.end if mark else f.size()
            while at is not None and at < end:
                f.seek(at)
                row, at = self._plain(f, at) if head.startswith(b"WARC/") else self._member(f, at, mark)
                if row is not None:
                    yield row

    def _passes(self, row: dict) -> bool:
        return all(row[c] is not None and COMPARE[kind](row[c], v) for kind, c, v in self.tests)

    def _checked(self, row: dict, payload: bytes, at: int) -> dict:
        if self.verify and row["warc_type"] == "response" and differs(payload, row["payload_digest"]):
            raise ValueError(f"{self.path}, byte {at}: the payload of {row['record_id']} differs from its digest")
        return row | {"payload": payload}

    def _plain(self, f, at: int) -> tuple[dict | None, int]:
        """The record of an uncompressed archive at a byte, if it passed, and where the next one begins."""
        text = b""
        while b"\r\n\r\n" not in text:
            more = f.read(4096)
            if not more:
                return None, f.size()
            text += more
        top, _, _ = text.partition(b"\r\n\r\n")
        row, length = self._headers(top)
        begin = at + len(top) + 4
        if not self._passes(row):
            return None, begin + length + 4
        if self.verify or "payload" in self.columns:
            f.seek(begin)
            row = self._checked(row, f.read(length), at)
        return row, begin + length + 4

    def _member(self, f, at: int, mark: bytes | None) -> tuple[dict | None, int]:
        """The record of the gzip member at a byte, if it passed, and where the next member begins."""
        head = f.read(1 << 16)
        if mark and mark_of(head) == mark:
            size = struct.unpack_from("<I", head, len(FIXED))[0]
            z, block = zlib.decompressobj(-15), head[HEAD : min(size - 8, len(head))]
        else:
            size, (z, block) = 0, (zlib.decompressobj(31), head)
        text, left = b"", block
        while b"\r\n\r\n" not in text and not z.eof:
            if not left and not (left := f.read(1 << 16)):
                break
            text += z.decompress(left, 4096)
            left = z.unconsumed_tail
        top, _, start = text.partition(b"\r\n\r\n")
        row, length = self._headers(top)
        passed = self._passes(row)
        wanted = passed and (self.verify or "payload" in self.columns)
        if wanted or not size:
            out, held = [start], len(start)
            while not z.eof and not (size and held >= length):
                chunk = left or f.read(1 << 20)
                if not chunk:
                    break
                out.append(z.decompress(chunk, 1 << 22) if wanted else z.decompress(chunk, 1 << 22)[:0])
                held, left = held + len(out[-1]), z.unconsumed_tail
            if wanted:
                row = self._checked(row, b"".join(out)[:length], at)
        return (row if passed else None), (at + size if size else f.tell() - len(z.unused_data))

    @staticmethod
    def _first(f, span: Span, mark: bytes) -> int | None:
        """The first member that begins in the range."""
        at, tail = span.start, b""
        f.seek(at)
        while at - len(tail) < span.end:
            chunk = f.read(1 << 20)
            if not chunk:
                return None
            data, base = tail + chunk, at - len(tail)
            k = data.find(MARK + mark)
            while k >= 0:
                if k >= HEAD - 12 and mark_of(data[k + 12 - HEAD : k + 12]) == mark:
                    return base + k + 12 - HEAD
                k = data.find(MARK + mark, k + 1)
            at, tail = at + len(chunk), data[-HEAD:]
        return None

    @staticmethod
    def _headers(top: bytes) -> tuple[dict, int]:
        found = {}
        for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            found[name.strip().lower()] = value.strip()
        row: dict = {c: found.get(h.lower()) for c, h in HEADERS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha256:") or None
        length = int(found.get("content-length", 0))
        row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else length
        return row, length


class WarcSource(DataSource):
    """``format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Registers the source and lets Spark offer it predicates."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame) -> DataFrame:
    """A record per page, in the columns of ``SCHEMA``: of equal payloads of at least 100 bytes the smallest page_id is the response.

    Only ids and digests are grouped and joined by digest; payloads move once, by page_id, so a
    payload that a third of all pages share makes no task larger.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    base = base.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    ids = base.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").drop("last")
    later = ids.join(first, "payload_digest").where("page_id <> first").distinct()
    rows = base.join(later, ["page_id", "payload_digest"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        "payload_digest",
        "payload_bytes",
        urn(F.col("first")).alias("refers_to"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the archives back, and returns a row per page.

    Responses are read whole and verified; of revisits, told apart by a pushed predicate, only headers are.
    """
    spark = pages.sparkSession
    register(spark)
    at = Scratch(spark, "warc").path("archive")
    page_records(pages).write.format("warc").mode("append").save(at)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    head = "record_id string, warc_type string, payload_digest string, payload_bytes long, refers_to string"
    whole = spark.read.format("warc").option("verify", "true").schema(head).load(at).where("warc_type = 'response'")
    again = spark.read.format("warc").schema(head).load(at).where("warc_type = 'revisit'")
    back = whole.unionByName(again)
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))
