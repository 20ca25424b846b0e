"""WARC archives as a Python data source, "warc": a writer, and a reader that plans parts of files, tests headers first and skips payloads.

Each record is a gzip member of its own, whose extra field "sl" (of the WARC standard's annex on compression) tells how long the member and its content are. The
reader inflates a member only as far as its header, tests record type and header predicates that Spark pushed down, and inflates
the block only if the record passes and its payload is wanted (option payload). A record that fails is skipped by its
length; members without that field, and plain files, are read through, so archives of others work too.

A writing task has a file of its own; its commit message names the file and the offsets of a record every split bytes. The commit
writes them to one list, and only listed files are read, so files of tasks that were lost or ran twice don't count. Parts of
files between such offsets are planned as partitions. A folder without a list is read by whole files.

Rows of WRITTEN may hold nulls in payload (empty), uri, refers_to and date, which are then left out. A record of type response or revisit has
an HTTP header with the length of the full payload; a revisit has no payload. Bytes of any kind and length pass unchanged. A record cut short
raises an error. Extra columns are not written. Folders are paths or URIs that pyarrow's file systems open, seen by driver and executors.
"""

from __future__ import annotations

import json
import operator
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from parcelwise.llm.common import remove, shared_dir, small, stored, text_of

#: What is written, in this order, and what is read. length is that of the payload, by the HTTP header where there is one.
WRITTEN = "record_type string, record_id string, uri string, date string, digest string, refers_to string, length long, payload binary"
READ = "record_type string, record_id string, uri string, date string, digest string, refers_to string, length long, payload binary, file string, offset long"
HEADERS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "uri", "WARC-Date": "date", "WARC-Payload-Digest": "digest", "WARC-Refers-To": "refers_to"}
IN_BRACKETS = ("record_id", "refers_to")
LIST = "_files.json"
SPLIT, AT_ONCE, FIRST = 64 << 20, 4 << 20, 2048


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def member(data: bytes, level: int = 6) -> bytes:
    """data as a gzip member whose extra field holds both lengths (as 32 bits; longer ones go without it)."""
    squeezed = zlib.compressobj(level, wbits=-15)
    body = squeezed.compress(data) + squeezed.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body)
    if max(whole, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data)) + body


def record_bytes(row: dict) -> bytes:
    payload, kind = row["payload"] or b"", row["record_type"]
    block = payload
    if kind in ("response", "revisit"):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["length"] + (payload if kind == "response" else b"")
    lines = ["WARC/1.1"]
    for name, column in HEADERS.items():
        if (value := row[column]) is not None:
            value = " ".join(value.split())
            lines.append(f"{name}: <{value}>" if column in IN_BRACKETS else f"{name}: {value}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if kind in ("response", "revisit"):
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    length: int
    offsets: list[int]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = open_folder(self.path)
        where.create_dir(folder, recursive=True)
        name, out, at, offsets = f"{uuid.uuid4().hex}.warc.gz", None, 0, []
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    out = where.open_output_stream(f"{folder}/{name}", compression=None)
                if not offsets or at - offsets[-1] >= self.split:
                    offsets.append(at)
                data = member(record_bytes(batch.slice(k, 1).to_pylist()[0]))
                out.write(data)
                at += len(data)
        if out is not None:
            out.close()
        return Written(name if out else None, at, offsets)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = open_folder(self.path)
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps([[m.name, m.length, m.offsets] for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = open_folder(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{folder}/{m.name}")


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int


class Record:
    """A record at an offset of a file: columns from its header at once, its payload on demand."""

    def __init__(self, file, at: int, end: int | None) -> None:
        self.file, self.at = file, at
        file.seek(at)
        head = file.read(FIRST if end is None else min(FIRST, end - at))
        self.packed, self.whole = head[:2] == b"\x1f\x8b", None
        self.inflate = zlib.decompressobj(31) if self.packed else None
        if self.packed and len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
            self.whole = struct.unpack_from("<I", head, 16)[0]
        self.read, self.data = 0, bytearray()
        self._take(head)
        while (cut := self.data.find(b"\r\n\r\n")) < 0:
            self._more()
        self._parse(bytes(self.data[:cut]))
        self.start = cut + 4
        self.size = self.start + self.length + 4
        self.columns["length"] = self.length
        self.http = 0
        if self.columns["record_type"] in ("response", "revisit") and self.http_type:
            while (cut := self.data.find(b"\r\n\r\n", self.start, self.start + self.length)) < 0 and len(self.data) < self.start + self.length:
                self._more()
            if cut >= 0:
                self.http = cut + 4 - self.start
                self.columns["length"] = self.length - self.http
                for line in bytes(self.data[self.start : cut]).split(b"\r\n"):
                    if line[:15].lower() == b"content-length:" and self.columns["record_type"] == "revisit":
                        self.columns["length"] = int(line[15:])

    def _take(self, raw: bytes) -> None:
        self.read += len(raw)
        if self.packed:
            raw = self.inflate.decompress(raw)
        self.data += raw

    def _more(self) -> None:
        raw = b"" if self.packed and self.inflate.eof else self.file.read(AT_ONCE if len(self.data) > FIRST * 8 else FIRST * 4)
        if not raw:
            raise ValueError(f"a record at offset {self.at} is cut short")
        self._take(raw)

    def _parse(self, head: bytes) -> None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {self.at}")
        named = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            named[name.strip().lower()] = value.strip()
        self.columns = {column: named.get(name.lower()) for name, column in HEADERS.items()}
        for c in IN_BRACKETS:
            if self.columns[c] is not None:
                self.columns[c] = self.columns[c].removeprefix("<").removesuffix(">")
        self.length = int(named["content-length"])
        self.http_type = named.get("content-type", "").startswith("application/http")

    def payload(self) -> bytes:
        while len(self.data) < self.size:
            self._more()
        return bytes(self.data[self.start + self.http : self.start + self.length])

    def next(self) -> int:
        """The offset of the record after this; a member of unknown length is inflated to its end for it."""
        if self.whole is not None:
            return self.at + self.whole
        if not self.packed:
            return self.at + self.size
        while not self.inflate.eof:
            self.data.clear()
            self._more()
        return self.at + self.read - len(self.inflate.unused_data)


def _equals(a, b) -> bool:
    return a is not None and a == b


#: Predicates that are tested on headers; like SQL's, they are false on null.
TESTS = {
    EqualTo: _equals,
    EqualNullSafe: operator.eq,
    GreaterThan: lambda a, b: a is not None and a > b,
    GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b,
    LessThanOrEqual: lambda a, b: a is not None and a <= b,
    In: lambda a, b: a is not None and a in b,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b),
    StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    StringContains: lambda a, b: a is not None and b in a,
}


def passes(test: Filter, row: dict) -> bool:
    if isinstance(test, Not):  # null stays false under NOT, but for the tests of null themselves
        inner = test.child
        return not passes(inner, row) and (isinstance(inner, (IsNull, IsNotNull, EqualNullSafe)) or row[inner.attribute[0]] is not None)
    value = row[test.attribute[0]]
    if isinstance(test, (IsNull, IsNotNull)):
        return (value is None) == isinstance(test, IsNull)
    return TESTS[type(test)](value, test.value)


def tells(test: Filter) -> bool:
    """Whether headers tell it."""
    if isinstance(test, Not):
        return not isinstance(test.child, Not) and tells(test.child)
    return type(test) in (IsNull, IsNotNull, *TESTS) and len(test.attribute) == 1 and test.attribute[0] in (*HEADERS.values(), "length")


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, names: list[str]) -> None:
        self.path, self.payload, self.names, self.tests = path, payload, names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if tells(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Part]:
        where, folder = open_folder(self.path)
        if where.get_file_info(f"{folder}/{LIST}").is_file:
            with where.open_input_stream(f"{folder}/{LIST}") as file:
                listed = json.loads(file.read())
        else:
            found = where.get_file_info(fs.FileSelector(folder, recursive=True))
            listed = [[f.path.removeprefix(folder).lstrip("/"), f.size, [0]] for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        return [Part(name, start, end) for name, length, offsets in listed for start, end in zip(offsets, offsets[1:] + [length])] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, folder = open_folder(self.path)
        rows, held, at = [], 0, partition.start
        with where.open_input_file(f"{folder}/{partition.file}") as file:
            while at < partition.end:
                record = Record(file, at, partition.end)
                if all(passes(test, record.columns) for test in self.tests):
                    payload = record.payload() if self.payload else None
                    rows.append(record.columns | {"payload": payload, "file": partition.file, "offset": at})
                    held += 400 + len(payload or b"")
                    if held > AT_ONCE:
                        yield self._batch(rows)
                        rows, held = [], 0
                at = record.next()
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], self.names)


class WarcSource(DataSource):
    """Options: path; payload (true, or false for null payloads); split, bytes between the offsets that a writer lists."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true", schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(data: Column) -> Column:
    """Four times ten hex digits are eight signs each; conv() has the digits 0 to V for base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", html_col: str = "html", uri_col: str = "url", split: int = SPLIT) -> None:
    """Write a record for each page to the folder path, which must be new. Of pages with equal payloads of min_bytes at least, that with the least id is a response, the others revisit it.

    Rows that repeat that id with that payload are responses too. A page with a null id revisits one that has an id, and is a response if none has. The least ids of
    payloads that occur again are found by aggregation; payloads themselves aren't shuffled unless there are more than a million of those.
    """
    register(pages.sparkSession)
    html = F.encode(text_of(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), html.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "length": F.octet_length("payload").cast("long")})
    again = rows.filter(F.col("length") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper")).filter("n > 1 AND keeper IS NOT NULL").select("digest", "keeper")
    again, kept = stored(again)
    rows = rows.join(small(again), "digest", "left").withColumn("refers", F.when((F.col("length") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    revisit = F.col("refers").isNotNull()
    out = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "uri", F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(F.lit("sha1:"), "digest").alias("digest"),
        F.when(revisit, name("refers")).alias("refers_to"), "length", F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("path", path).option("split", split).save()
    remove(pages.sparkSession, kept)


def records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. Those of responses are taken from the payload that is read; of revisits, from headers alone."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS long)")
    columns = lambda size, digest: [number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")]
    whole = records(spark, path).filter(F.col("record_type") == "response").select(*columns(F.octet_length("payload").cast("long"), base32_sha1(F.col("payload"))))
    return whole.unionByName(records(spark, path, payload=False).filter(F.col("record_type") == "revisit").select(*columns(F.col("length"), F.substring("digest", 6, 32))))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to a new folder of the shared one and read the archives, which stay, back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(pages, path, min_bytes)
    return read_pages(spark, path)


#: The same over the table pages; the digest is cut from the hex digits of SHA-1.
SQL = """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + CAST((
    (instr('0123456789abcdef', h[(5 * i) // 4 + 1]) - 1) * 16 + coalesce(instr('0123456789abcdef', h[(5 * i) // 4 + 2]) - 1, 0)) >> (3 - CAST((5 * i) % 4 AS INTEGER)) AS INTEGER) % 32]), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM told
"""
