"""WARC archives: writing pages as records, and reading records by verified boundary chains.

Writing. A page is one record of WARC 1.1. Of the pages with equal payloads of at least ``least`` bytes the one with the smallest
page_id is a ``response``, the others are ``revisit`` records that refer to it and carry no payload; smaller payloads are all
responses. Spark's text writer ends each record with the two line ends that the format asks for, so archives are written by
tasks, committed as a whole and open to any file system.

Reading. Archives are cut wherever a line holds the version, by Spark's text reader, in byte ranges of any size. Each cut is
only a candidate: a payload may hold the same line, or a whole record. Tasks emit for each candidate of their range the offset
of its successor, as its header states it, and follow these links inside the range up to the first offset outside it. Pointer
jumping over the ranges, from the start of each file, then tells which candidates are entered; a second local pass keeps the
records on the chain and rejects all others. A chain that does not end exactly at the end of its file raises an error.
Payloads that held candidates are put together again from their pieces.

Defined cases: null html is an empty payload; null page_id is written ``-`` and is never the smallest (payloads that only such pages
have are all responses); repeated rows that hold the smallest page_id are all responses; null url is written as the record's own id, line ends in it as %0D and %0A; a payload of any length is
one value; an empty table gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, tables_by

VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Where archives are cut. No prefix of it ends as it begins, so a search that goes on after a mismatch misses nothing.
CUT = "\n" + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows broadcast at most: digests of repeated payloads, ranges, responses that are referred to.
BROADCAST_ROWS = 200_000


# --- writing -------------------------------------------------------------------------------


def write_warc(pages: DataFrame, path: str, scratch: Scratch, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archives of pages(page_id, url, html) to a new folder."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = scratch.put(firsts)
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), F.col("digest"), F.lit(">"))
    own = name(F.col("page_id"))
    uri = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.substring(own, F.lit(2), F.length(own) - 2))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        own,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


# --- parsing of one candidate ----------------------------------------------------------------


def _parsed(text: Column, payload: bool) -> list[Column]:
    """What the text behind a version line says, if it is a record: lengths in bytes, header fields, digest and size of the payload."""
    head = F.substring_index(text, END, 1)
    field = lambda name, value: F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*({value})[ \t]*(?=\r\n|$)", 1)
    h = F.octet_length(head).cast("long")
    c = field("Content-Length", r"\d{1,18}").try_cast("long")
    size = F.octet_length(text).cast("long")
    is_record = c.isNotNull() & (size >= h + 4)
    whole = is_record & (size >= h + 4 + c + 3)
    # the payload is what follows the HTTP header in the block, if there is one
    inner = F.octet_length(F.substring_index(text, END, 2)).cast("long") + 4
    start = F.when((field("Content-Type", "[^;\r]*").isin("application/http")) | field("Content-Type", "[^\r]*").startswith("application/http;"), F.when(inner <= h + 4 + c, inner).otherwise(h + 4)).otherwise(h + 4)
    data = F.substring(text.cast("binary"), (start + 1).cast("int"), (h + 4 + c - start).cast("int"))
    declared = F.lower(field("WARC-Payload-Digest", r"sha256:[0-9A-Fa-f]{64}"))
    kind = F.lower(field("WARC-Type", "[A-Za-z]+"))
    digest = F.when(whole, F.sha2(data, 256))
    return [
        F.when(is_record, h + 4 + c + 4).alias("extent"),
        F.coalesce(whole, F.lit(False)).alias("whole"),
        kind.alias("record_type"),
        field("WARC-Record-ID", "[^\r]*?").alias("record_id"),
        F.nullif(field("WARC-Refers-To", "[^\r]*?"), F.lit("")).alias("refers_to"),
        field("WARC-Target-URI", "[^\r]*?").alias("target_uri"),
        F.nullif(F.substring(declared, 8, 64), F.lit("")).alias("declared"),
        digest.alias("payload_digest"),
        F.when(whole, h + 4 + c - start).alias("payload_bytes"),
        (F.when(whole, data) if payload else F.lit(None).cast("binary")).alias("payload"),
    ]


FIELDS = "record_type string, record_id string, refers_to string, target_uri string, declared string, payload_digest string, payload_bytes long, payload binary"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between two cuts, in the order of the file inside each range (file, block)."""
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value", F.octet_length("value").cast("long").alias("bytes")
    )


def _numbers(part: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return part.column(name).fill_null(null).to_numpy()


def _positions(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where the text of each piece and its record would begin, counted from the first byte of the range's first piece."""
    at = np.concatenate([[0], np.cumsum(_numbers(part, "bytes") + len(CUT))])[:-1]
    start = at - len(VERSION)
    if part.column("block")[0].as_py() == 0:
        start[0] = 0  # the piece at the start of a file holds its version line
    return at, start


def _followers(start: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """The row of the same range where a row's successor begins, else -1."""
    to = np.minimum(np.searchsorted(start, succ), len(start) - 1)
    return np.where((succ >= 0) & (start[to] == succ), to, -1)


LINKS = "file string, block long, size long, span long, start long, succ long, leaves long, whole boolean, " + FIELDS


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate its successor, and ``leaves``: where its chain leaves the range (-1: nowhere)."""
    for part in tables_by(batches, "file", "block"):
        _, start = _positions(part)
        first = np.zeros(len(start), bool)
        first[0] = part.column("block")[0].as_py() == 0
        lead = part.column("lead").to_numpy()
        extent = _numbers(part, "extent", -1)
        # a version line twice in a row is no record, and a file begins with one
        succ = np.where((extent >= 0) & (lead == first), start + len(VERSION) + extent, -1)
        to = _followers(start, succ)
        end = np.where(to >= 0, to, np.arange(len(to)))
        while (after := end[end]).tobytes() != end.tobytes():
            end = after
        columns = {"span": _numbers(part, "bytes") + len(CUT), "start": start, "succ": succ, "leaves": succ[end]}
        names = [f.split()[0] for f in LINKS.split(", ")]
        done = pa.table({n: pa.array(columns[n], pa.int64()) if n in columns else part.column(n) for n in names})
        yield from done.to_batches(max_chunksize=1000)


def _on_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each range that lie on the chain from its entry."""
    for part in tables_by(batches, "file", "block"):
        to = _followers(_numbers(part, "start"), _numbers(part, "succ")).tolist()
        at, keep = int(np.searchsorted(_numbers(part, "start"), part.column("entry")[0].as_py())), []
        while at >= 0:
            keep.append(at)
            at = to[at]
        yield from part.take(pa.array(keep)).to_batches(max_chunksize=1000)


def _with_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tables_by(batches, "file", "block"):
        _, start = _positions(part)
        yield from pa.table({"file": part.column("file"), "block": part.column("block"), "start": pa.array(start), "value": part.column("value")}).to_batches(max_chunksize=100)


# --- reading -------------------------------------------------------------------------------


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def read_warc(spark: SparkSession, path: str, scratch: Scratch, payload: bool = False) -> DataFrame:
    """The records of the archives in a folder: file, offset, record_type, record_id, refers_to, target_uri, payload_bytes,
    payload_digest (sha256, of the bytes read) and, if asked for, payload. A digest of sha256 that the header states is compared."""
    value = F.col("value")
    lead = value.startswith(VERSION)
    text = F.when(lead, F.expr(f"substring(value, {len(VERSION) + 1})")).otherwise(value)
    cuts = _pieces(spark, path).select("file", "block", "size", "bytes", lead.alias("lead"), *_parsed(text, payload))
    links = scratch.put(cuts.mapInArrow(_links, LINKS))
    ranges = links.groupBy("file", "block").agg(F.sum("span").alias("span"))
    ranges = scratch.put(ranges.select("file", "block", F.coalesce(F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.count(F.lit(1)).over(Window.partitionBy("file")).alias("blocks")))
    n, most = ranges.agg(F.count(F.lit(1)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    moved = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.lit(-1)).alias(c)
    links = links.join(_small(ranges.select("file", "block", "base"), n), ["file", "block"]).select(
        "file", "block", "size", (F.col("start") + F.col("base")).alias("start"), moved("succ"), moved("leaves"), "whole", *[f.split()[0] for f in FIELDS.split(", ")]
    )
    entries = _entries(links, most, scratch)
    entered = links.join(_small(entries, n), ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "start")
    records = scratch.put(entered.mapInArrow(_on_chain, entered.schema).drop("entry"))
    # each file that holds a byte must have a chain that ends with it
    ends = records.groupBy("file").agg(F.max("succ").alias("end"))
    sizes = links.groupBy("file").agg(F.max("size").alias("size"))
    torn = sizes.join(ends, "file", "left").where(~F.col("end").eqNullSafe(F.col("size"))).agg(F.count(F.lit(1)), F.min("file")).first()
    if torn[0]:
        raise ValueError(f"{torn[0]} archives with a chain of records that does not reach the end, the first {torn[1]}")
    parted = records.where("not whole")
    if parted.limit(1).count():
        records = records.where("whole").unionByName(_joined(spark, path, parted, ranges, n, payload, scratch))
    stated = F.col("declared").isNull() | (F.col("record_type") == "revisit") | (F.col("declared") == F.col("payload_digest"))
    digest = F.when(stated, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload differs from the digest of its record "), F.col("record_id"))))
    return records.select("file", F.col("start").alias("offset"), "record_type", "record_id", "refers_to", "target_uri", "payload_bytes", digest.alias("payload_digest"), *(["payload"] if payload else []))


def _entries(links: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(file, block, entry): where the chain from a file's start enters each range that it enters, by pointer jumping."""
    nodes = links.where("succ >= 0").select("file", F.col("start").alias("at"), "block", "leaves")
    if most <= 1:
        return nodes.where("at = 0").select("file", "block", F.col("at").alias("entry"))
    entered = nodes.select("file", F.col("leaves").alias("at")).distinct()
    nodes = scratch.put(nodes.where("at = 0").unionByName(nodes.where("at > 0").join(entered, ["file", "at"], "left_semi")))
    jump = nodes.select("file", "at", F.col("leaves").alias("to"))
    reached = scratch.put(nodes.where("at = 0").select("file", "at"))
    for step in range(math.ceil(math.log2(most)) + 1):
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = scratch.put(reached.unionByName(onward).distinct())
        if 2 ** (step + 1) <= most:
            twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))).select("a.file", "a.at", "b.to")
            jump = scratch.put(twice)
    return nodes.join(reached, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"))


def _joined(spark: SparkSession, path: str, parted: DataFrame, ranges: DataFrame, n: int, payload: bool, scratch: Scratch) -> DataFrame:
    """The records whose payload was cut, put together from the pieces between their start and their successor.

    Each range gets the part of each such record that lies in it, and each piece the record that began last before it."""
    base = ranges.select("file", "block", "base")
    own = parted.select("file", "block", "start", "succ", F.col("start").alias("begin"))
    ends = base.withColumn("limit", F.lead("base").over(Window.partitionBy("file").orderBy("block")))
    far = own.join(ends.select("file", "block", "limit"), ["file", "block"]).where("succ > limit").select("file", "start", "succ")
    beyond = far.join(base, "file").where("base > start and base < succ").select("file", "block", "start", "succ", F.expr(f"base - {len(VERSION)}").alias("begin"))
    marks = scratch.put(own.unionByName(beyond))
    blocks = scratch.put(marks.select("file", "block").distinct())
    wanted = _pieces(spark, path)
    if (k := blocks.count()) <= BROADCAST_ROWS:
        wanted = wanted.join(_small(blocks, k), ["file", "block"], "left_semi")
    cut = wanted.select("file", "block", "bytes", "value").mapInArrow(_with_positions, "file string, block long, start long, value string")
    cut = cut.join(_small(base, n), ["file", "block"]).select("file", "block", F.lit(None).cast("long").alias("record"), F.lit(None).cast("long").alias("end"), (F.col("start") + F.col("base")).alias("begin"), "value")
    both = cut.unionByName(marks.select("file", "block", F.col("start").alias("record"), F.col("succ").alias("end"), "begin", F.lit(None).cast("string").alias("value")))
    so_far = Window.partitionBy("file", "block").orderBy("begin", F.col("value").isNotNull())
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    found = both.select("file", "begin", "value", last("record"), last("end")).where("value is not null and begin < end")
    texts = found.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "value"))), lambda p: p["value"]), CUT).alias("value"))
    text = F.when((F.col("record") == 0), F.expr(f"substring(value, {len(VERSION) + 1})")).otherwise(F.col("value"))
    again = texts.select("file", F.col("record").alias("start"), *[c for c in _parsed(text, payload)]).drop("extent", "whole")
    placed = parted.select("file", "block", "size", "start", "succ", "leaves", F.lit(True).alias("whole"))
    return scratch.put(placed.join(again, ["file", "start"]))


def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Gives each revisit the size and digest of the payload of the record that it refers to; one that refers to none raises an error."""
    records = records.select("record_type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest")
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    named = scratch.put(records.where("record_type <> 'revisit'").join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("full_bytes"), F.max("payload_digest").alias("full_digest")))
    joined = records.join(_small(named, named.count()), "refers_to", "left")
    revisit = F.col("record_type") == "revisit"
    known = F.when(F.col("full_digest").isNull(), F.raise_error(F.concat(F.lit("no record "), F.coalesce("refers_to", F.lit("-"))))).otherwise(F.col("full_digest"))
    return joined.select(
        "record_type", "record_id", "refers_to", "target_uri",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, known).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    with Scratch(spark) as scratch:
        path = scratch.folder()
        write_warc(pages, path, scratch)
        records = scratch.put(read_warc(spark, path, scratch))
        page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+):", 1).try_cast("long")
        return scratch.keep(resolve_revisits(records, scratch).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))


OP11_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
