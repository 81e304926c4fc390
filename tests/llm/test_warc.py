"""WARC archives against a reader that walks a file from its start, and pages that hold records themselves."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import registry, warc
from millrace.llm.common import Scratch

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77:x>\r\nContent-Type: text/plain\r\nContent-Length: 11\r\n\r\nhello world\r\n\r\n"
PAGES = [
    (1, "http://a", "<p>" + "x" * 200), (2, "http://b", "<p>" + "x" * 200), (9, "http://i", "<p>" + "x" * 200), (3, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (6, "http://e\r\nWARC-Type: metadata\r\n", ""),
    (7, "http://f/WARC/1.1", "before\r\n\r\n" + RECORD * 3 + "after"), (8, "http://g", RECORD), (10, "http://h", RECORD * 40), (11, "http://h", RECORD * 40), (12, "u", "\nWARC/1.1\r\n" * 30), (13, "é ", "ça 漢字 \x00 ﻿" * 90),
    (14, "http://j", "x\nWARC/1.1\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"), (None, "http://k", "<p>" + "x" * 200), (None, "http://k", "<p>" + "y" * 200), (15, "http://l", "\r\n\r\n" * 60), (16, "z", "Content-Length: 3\r\n\r\n" + RECORD),
    (17, "twice", "t" * 150), (17, "twice", "t" * 150), (18, "twice", "t" * 150), (19, "long", ("long text " * 20 + "\r\n\r\n" + RECORD) * 300),
]
KIND = "page_id long, url string, html string"


def _frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    for name in ("digest", "first", "file", "block", "start", "value", "bytes", "payload"):
        df = df.withColumn(name, F.lit(1))
    return df


def _walk(data: bytes):
    """Records of an archive by walking from its start: (offset, head, payload)."""
    at = 0
    while at < len(data):
        assert data[at : at + 10] == b"WARC/1.1\r\n"
        gap = data.index(b"\r\n\r\n", at)
        head = data[at:gap].decode()
        block = data[gap + 4 :][: int(re.search(r"\r\nContent-Length: (\d+)", head)[1])]
        assert data[gap + 4 + len(block) :][:4] == b"\r\n\r\n"
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = gap + 4 + len(block) + 4


def _plain(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        again = len(data) >= 100 and bool(ids) and page != min(ids)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", ["128m", "3k"])
def test_records_are_those_of_the_walk(spark, tmp_path, range_bytes):
    path = str(tmp_path / "warc")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        with Scratch(spark) as scratch:
            warc.write_warc(_frame(spark, PAGES), path, scratch)
            spark.conf.set(name, range_bytes)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = sorted((r.file.rsplit("/", 1)[1], r.offset, r.record_type, bytes(r.payload), r.payload_digest if r.record_type == "response" else None) for r in warc.read_warc(spark, path, scratch, payload=True).collect())
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for file in (tmp_path / "warc").glob("part-*"):
        for at, head, payload in _walk(file.read_bytes()):
            kind = re.search(r"\r\nWARC-Type: (\w+)", head)[1]
            want.append((file.name, at, kind, payload, hashlib.sha256(payload).hexdigest() if kind == "response" else None))
    assert got == sorted(want) and len(got) == len(PAGES)


def _saved(spark, folder, rows):
    _frame(spark, rows).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_query(spark, tmp_path):
    folder = _saved(spark, tmp_path, PAGES)
    got = registry.QUERIES["op11_warc"](spark, folder)
    rows = sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert rows == _plain(PAGES)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    assert rows == sorted(db.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({registry.ORACLES['op11_warc']})").fetchall(), key=str)


@pytest.mark.parametrize("harm", ["cut", "grown", "start", "inside"])
def test_damaged_archives_raise(spark, tmp_path, harm):
    path = tmp_path / "warc"
    with Scratch(spark) as scratch:
        warc.write_warc(spark.createDataFrame(PAGES[:8], KIND).coalesce(1), str(path), scratch)
        file = next(path.glob("part-*"))
        data = file.read_bytes()
        data = {"cut": data[:-40], "grown": data + b"more", "start": b"x" + data, "inside": data.replace(b"<p>xx", b"<p>xy")}[harm]
        for crc in path.glob(".part-*"):
            crc.unlink()
        file.write_bytes(data)
        with pytest.raises(Exception, match="digest" if harm == "inside" else "chain"):
            warc.read_warc(spark, str(path), scratch).collect()


def test_revisit_of_nothing_raises(spark):
    row = spark.createDataFrame([("revisit", "<a>", "<b>", "u", 0, "d")], "record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string")
    with Scratch(spark) as scratch, pytest.raises(Exception, match="no record"):
        warc.resolve_revisits(row, scratch).collect()
