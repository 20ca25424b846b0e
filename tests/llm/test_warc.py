import gzip
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import entry, warc

SCHEMA = "page_id long, url string, html string, record_type string, payload int"
PAGES = [
    (5, "http://a/5", "<p>one</p>"), (3, "http://a/3", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "http://b/1\r\nX: y", "<p>two</p>"), (2, "http://b/2", None), (4, "http://b/4", ""),
    (7, "http://c/7", "WARC/1.1\r\n\r\n\x00ünïcode ☃"), (7, "http://c/7", "WARC/1.1\r\n\r\n\x00ünïcode ☃"), (None, "http://d/", "<p>one</p>"), (None, None, "alone"), (11, "http://e/11", "x" * 300_000 + "é" * 50_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "response", 1) for p in PAGES], SCHEMA).repartition(3)


def expected(min_bytes=0):
    import base64
    import hashlib

    out = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        ids = [i for i, _, h in PAGES if (h or "") == (html or "") and i is not None]
        keeper = min(ids) if ids and len(data) >= min_bytes else page_id
        revisit = page_id != keeper
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5, 10**6])
def test_pages_come_back(pages, min_bytes):
    assert sorted(map(tuple, warc.round_trip(pages, min_bytes).collect()), key=repr) == expected(min_bytes)


def test_an_empty_table(pages):
    assert warc.round_trip(pages.filter("false")).count() == 0


@pytest.fixture(scope="module")
def written(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.archive(pages, path, split=100)
    return path


def test_predicates_are_tested_on_headers(spark, written):
    got = warc.records(spark, written)
    plain = spark.createDataFrame(got.collect(), got.schema)
    for test in [
        F.col("record_type") == "revisit", F.col("record_type") != "revisit", F.col("refers_to").isNull(), ~F.col("refers_to").isNull(), F.col("uri").startswith("http://a"), ~F.col("uri").contains("a"), F.col("uri").endswith("7"),
        F.col("length") > 9, F.col("record_id").isin("urn:page:3", "urn:page:4"), ~F.col("record_id").isin("urn:page:3"), F.col("uri").eqNullSafe(None), (F.col("length") <= 10) & (F.col("uri") < "http://c"), F.length("uri") == 10,
    ]:
        found = got.filter(test)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.filter(test).collect()))
    plan = got.filter((F.col("record_type") == "revisit") & (F.length("uri") == 10))._jdf.queryExecution().executedPlan().toString()
    assert "(length(uri" in plan and "= revisit" not in plan
    assert warc.records(spark, written, payload=False).filter("payload IS NOT NULL").count() == 0


def test_parts_of_files_are_partitions(written):
    reader = warc.Reader(written, True, [c.split()[0] for c in warc.READ.split(", ")])
    parts = reader.partitions()
    assert len(parts) > len({p.file for p in parts}) > 0
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(PAGES)


def test_files_of_lost_tasks_do_not_count(spark, written):
    import pathlib
    import shutil

    folder = pathlib.Path(written)
    file = next(folder.glob("*.warc.gz"))
    shutil.copy(file, folder / "lost.warc.gz")
    assert warc.records(spark, written).count() == len(PAGES)


def test_unwanted_payloads_are_not_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    import random

    big = random.Random(1).randbytes(3_000_000)
    row = {"record_type": "response", "record_id": "urn:page:1", "uri": "u", "date": None, "digest": "sha1:X", "refers_to": None, "length": len(big), "payload": big}
    data = warc.member(warc.record_bytes(row))
    file = Counting(data * 2)
    first = warc.Record(file, 0, None)
    second = warc.Record(file, first.next(), None)
    assert first.columns == second.columns and second.next() == 2 * len(data) and file.taken < 10_000
    assert second.payload() == big


def test_archives_of_others(spark, tmp_path):
    def record(kind, body, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:x>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\ngone"
    all_of = [record("warcinfo", b"software: x\r\n"), record("response", http, "Content-Type: application/http;msgtype=response\r\n"), record("resource", b"\xff\x00\xfe" * 9000)]
    (tmp_path / "a.warc").write_bytes(b"".join(all_of))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, all_of)))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = warc.records(spark, f"file://{tmp_path}").orderBy("file", "offset").collect()
    assert [(r.record_type, r.length, bytes(r.payload)) for r in got] == [("warcinfo", 13, b"software: x\r\n"), ("response", 4, b"gone"), ("resource", 27000, b"\xff\x00\xfe" * 9000)] * 2
    (tmp_path / "a.warc").write_bytes(b"".join(all_of)[:-3000])
    with pytest.raises(Exception, match="cut short"):
        warc.records(spark, str(tmp_path)).collect()


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = entry.op11_warc(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(warc.SQL).fetchall())
