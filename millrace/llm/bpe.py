"""Byte-level BPE encoding and decoding, with overlapping chunks for long texts.

A text longer than ``chunk`` code points is cut into chunks that overlap. The chunks are rows
of their own and are pre-tokenised in parallel. The matches of the pre-tokeniser depend only on
the position where a match begins and on what follows, so two chains of matches that share
one boundary agree from there on. Neighbouring chunks are stitched at the first boundary that both
chains have in the overlap; the text between two stitches is a piece that is encoded on its
own. A boundary serves only if the character before it isn't white space (a white-space match
looks ahead, and the end of a piece must not change it) and if the chunk's own end is far
enough away.

Where an overlap has no common boundary (a run of letters longer than the overlap), the chain of the chunk before it
is carried on through the next chunk, and further where that overlap has none either, until an overlap has one: only
these chunks meet in one task, the pieces are cut at the carried chain's boundaries, and behind them the chunks' own chains hold again.
If the carried chain should miss what the chunks' own chains agree on, the text is one piece, so the ids are right in any case.

A text of one chunk is its own piece and is encoded where it is read, without a shuffle.

Defined cases: null text counts as empty: no ids. Rows with equal doc_id and text are one
document while they are chunked and come back as often as they were there. Extra columns are
ignored. Very long texts are what the chunks are for; where white space goes on for ``SPACE`` code points, which overflows tiktoken's
matcher, a piece's matches are encoded one by one, to the same ids; an empty table gives no rows. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

CHUNK = 1 << 15
OVERLAP = 1 << 11
#: A match that ends nearer to a chunk's end than this might be another one in the whole text.
_MARGIN = 8
#: White space at a stretch that is left to tiktoken's matcher at most: its stack overflows at a million code points.
SPACE = 1 << 19


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> list[bytes]:
    out = [b""] * (max(_ranks(path).values()) + 1)
    for token, rank in _ranks(path).items():
        out[rank] = token
    return out


@cache
def _matcher(pattern: str):
    return regex.compile(pattern)


def long_space(text: str) -> bool:
    """Whether ``SPACE`` or more code points of white space follow each other."""
    return len(text) >= SPACE and any(m.end() - m.start() >= SPACE for m in _matcher(r"\s+").finditer(text))


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    if not long_space(text):
        return encoder(path, pattern).encode_ordinary(text)
    one = encoder(path, r"(?s:.+)").encode_ordinary  # takes all it gets as one match
    return [i for m in _matcher(pattern).finditer(text) for i in one(m[0])]


def safe_boundaries(text: str, pattern: str, first: int, last: int, closed: bool) -> list[int]:
    """Ends of the matches in [first, last] at which a piece may end, for a chain from 0.

    closed: the text's end is the end of the whole text.
    """
    reach = len(text) if closed else len(text) - _MARGIN
    out = []
    for match in _matcher(pattern).finditer(text):
        end = match.end()
        if end > min(last, reach):
            break
        if end >= first and not text[end - 1].isspace():
            out.append(end)
    return out


def agreed(lefts: list, rights: list) -> list[int]:
    """For each chunk, from the boundaries that it has in its overlaps with the one before and the one after: where a
    piece begins in it, or -1 where its overlap with the one before has no common boundary.

    Chunk k's chain is the true one from its own beginning of a piece on, so agreement with it proves the next one."""
    out = [0]
    for k in range(1, len(lefts)):
        common = set(rights[k - 1]).intersection(lefts[k])
        out.append(min(common) if common else -1)
    return out


def stretches(begins: list[int]) -> list[tuple[int, int]]:
    """(first, last) of the runs of chunks through which a chain must be carried on."""
    out = []
    for k, at in enumerate(begins):
        if at < 0:
            if out and out[-1][1] == k - 1:
                out[-1] = (out[-1][0], k)
            else:
                out.append((k - 1, k))
    return out


def carried(text: str, first: int, last: int, closed: bool, left: list[int], pattern: str, chunk: int, overlap: int) -> list[int]:
    """Where pieces begin in the chunks first + 1 .. last, and in the one after (-1: in none), from the text of the
    stretch, which begins at chunk ``first``; left: the boundaries that the chunk after it has. [-2] if the chain misses them."""
    base = first * chunk
    found = [base + x for x in safe_boundaries(text, pattern, 0, len(text), closed)]
    out = []
    for k in range(first + 1, last + 1):
        own = [x for x in found if k * chunk <= x < min((k + 1) * chunk, base + len(text))]
        out.append(own[0] if own else -1)
    if not closed:
        common = set(found).intersection(left)
        if not common:
            return [-2]
        out.append(min(common))
    return out


def mended(begins: list[int], first: list[int], parts: list[list[int]]) -> list[int]:
    """The beginnings of pieces with those of the carried chains (by first chunk of each stretch) put in."""
    out = list(begins)
    for k, own in zip(first, parts):
        if -2 in own:
            return [0] + [-1] * (len(begins) - 1)
        out[k + 1 : k + 1 + len(own)] = own
    return out


def segments(begins: list[int], chunk: int, overlap: int) -> list[dict]:
    """For each piece, the parts of chunks that it is made of; high is -1 at the end of the text. A piece that ends in the
    overlap of a chunk with the one after is cut from the former."""
    starts = [(k, at) for k, at in enumerate(begins) if at >= 0]
    out = []
    for (k, at), (after, end) in zip(starts, [*starts[1:], (len(begins), -1)]):
        last = max(k, after if end > after * chunk + overlap else after - 1)
        for i in range(k, last + 1):
            out.append({"k": i, "piece": at, "low": max(at, i * chunk) if i == k else i * chunk, "high": end if i == last else (i + 1) * chunk})
    return out


def _edges(part: str, k: int, n: int, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    base, closed = k * chunk, k == n - 1
    found = safe_boundaries(part, pattern, 0, len(part), closed)
    left = [base + x for x in found if x <= overlap] if k else []
    right = [] if closed else [base + x for x in found if x >= chunk]
    return left, right


def split_pieces(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """One text's pieces on one machine: what the distributed path makes, to test it."""
    n = max(1, -(-len(text) // chunk))
    lefts, rights = zip(*[_edges(text[k * chunk : (k + 1) * chunk + overlap], k, n, pattern, chunk, overlap) for k in range(n)])
    begins = agreed(lefts, rights)
    runs = stretches(begins)
    parts = [carried(text[a * chunk : (b + 1) * chunk + overlap], a, b, b == n - 1, lefts[b + 1] if b < n - 1 else [], pattern, chunk, overlap) for a, b in runs]
    at = [x for x in mended(begins, [a for a, _ in runs], parts) if x >= 0]
    return [text[i:j] for i, j in zip(at, [*at[1:], len(text)])]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, texts: str = "text") -> Iterator[pa.RecordBatch]:
    """Replaces the column of texts by their ids (list<int32>)."""
    for batch in batches:
        at = batch.schema.get_field_index(texts)
        names = [x for x in batch.schema.names if x != texts]
        for some in range(0, batch.num_rows, 128):
            part = batch.slice(some, 128)
            ids = [np.array(encode_text(x, path, pattern) if x else [], dtype=np.int32) for x in part.column(at).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), lists], [*names, "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Appends the bytes of the column ids."""
    tokens = _token_bytes(path)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        for some in range(0, batch.num_rows, 128):  # a few documents' ids as Python numbers at a time
            part = batch.slice(some, 128)
            ids = part.column(at)
            places = ids.offsets.to_numpy()
            values = ids.values.to_numpy()
            raw = [b"".join(map(tokens.__getitem__, values[i:j].tolist())) for i, j in zip(places, places[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, ids array<int>."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    short = docs.where(F.length("text") <= chunk).mapInArrow(lambda b: encode_batches(b, path, pattern), f"doc_id {id_type}, ids array<int>")
    long = docs.where(F.length("text") > chunk)
    return short.unionByName(_encode_long(long, path, pattern, chunk, overlap, id_type))


def _cut(batches: Iterator[pd.DataFrame], chunk: int, overlap: int, at_once: int = 64) -> Iterator[pd.DataFrame]:
    """The chunks of each text, each with the overlap behind it, ``at_once`` at a time."""
    for batch in batches:
        for key, n, text in zip(batch["key"], batch["n"], batch["text"]):
            for low in range(0, n, at_once):
                some = range(low, min(n, low + at_once))
                yield pd.DataFrame({"key": key, "n": n, "k": some, "part": [text[i * chunk : (i + 1) * chunk + overlap] for i in some]})


def _encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, id_type: str) -> DataFrame:
    """Chunks are dealt out by document and number. What meets by document are the boundaries in
    the overlaps, a few hundred numbers a chunk, and at the end the ids themselves."""
    key = F.sha2(F.concat_ws("\n", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"), "text"), 256)
    keyed = docs.select(key.alias("key"), "doc_id", "text", F.ceil(F.length("text") / chunk).cast("int").alias("n"))
    scratch = Scratch(docs.sparkSession)
    rows = keyed.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    k = F.col("k")
    # cut in one pass; copies of a document give equal chunks
    chunks = keyed.select("key", "n", "text").mapInPandas(lambda b: _cut(b, chunk, overlap), "key string, n int, k int, part string").dropDuplicates(["key", "k"])

    @F.pandas_udf("struct<left:array<int>,right:array<int>>")
    def edges(part: pd.Series, k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_edges(p, int(i), int(m), pattern, chunk, overlap) for p, i, m in zip(part, k, n)], columns=["left", "right"])

    near = chunks.select("key", "k", edges("part", "k", "n").alias("e"))
    known = scratch.put(near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("all")).select("key", F.col("all.e.left").alias("lefts"), F.col("all.e.right").alias("rights")))

    @F.pandas_udf("array<int>")
    def begin(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([agreed(list(a), list(b)) for a, b in zip(lefts, rights)])

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def missed(begins: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "last": b} for a, b in stretches(list(x))] for x in begins])

    @F.pandas_udf("array<int>")
    def carry(text: pd.Series, first: pd.Series, last: pd.Series, closed: pd.Series, left: pd.Series) -> pd.Series:
        return pd.Series([carried(t, int(a), int(b), bool(c), list(x), pattern, chunk, overlap) for t, a, b, c, x in zip(text, first, last, closed, left)])

    @F.pandas_udf("array<struct<k:int,piece:int,low:int,high:int>>")
    def planned(begins: pd.Series, firsts: pd.Series, parts: pd.Series) -> pd.Series:
        fixed = [mended(list(b), list(f), [list(x) for x in p]) if f is not None else list(b) for b, f, p in zip(begins, firsts, parts)]
        return pd.Series([segments(x, chunk, overlap) for x in fixed])

    # stretches without agreement: only their chunks meet
    begins = known.select("key", "lefts", begin("lefts", "rights").alias("begins"))
    runs = begins.select("key", "lefts", F.explode(missed("begins")).alias("s")).select("key", F.col("s.first").alias("first"), F.col("s.last").alias("last"), F.coalesce(F.get("lefts", F.col("s.last") + 1), F.expr("cast(array() as array<int>)")).alias("left"), (F.col("s.last") + 1 == F.size("lefts")).alias("closed"))
    within = runs.join(chunks, "key").where((k >= F.col("first")) & (k <= F.col("last")))
    own = F.when(k < F.col("last"), F.substring("part", F.lit(1), F.lit(chunk))).otherwise(F.col("part"))
    text = within.groupBy("key", "first", "last", "closed", "left").agg(F.sort_array(F.collect_list(F.struct("k", own.alias("part")))).alias("t"))
    mends = text.select("key", "first", carry(F.array_join("t.part", ""), "first", "last", "closed", "left").alias("own"))
    mends = mends.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "own"))).alias("m")).select("key", F.col("m.first").alias("firsts"), F.col("m.own").alias("owns"))
    plan = begins.select("key", "begins").join(mends, "key", "left").select("key", F.explode(planned("begins", "firsts", "owns")).alias("p")).select("key", "p.*")
    high = F.when(F.col("high") < 0, F.lit(1 << 30)).otherwise(F.col("high") - F.col("low"))
    part = F.substring("part", F.col("low") - k * chunk + 1, high)
    pieces = chunks.join(plan, ["key", "k"]).select("key", "piece", "k", part.alias("part"))
    pieces = pieces.groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("t"))
    pieces = pieces.select("key", "piece", F.array_join("t.part", "").alias("text"))
    ids = pieces.mapInArrow(lambda b: encode_batches(b, path, pattern), "key string, piece int, ids array<int>")
    whole = ids.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("t")).select("key", F.flatten("t.ids").alias("ids"))
    return whole.join(rows, "key").select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Appends ``decoded``, the bytes of the column ``ids``."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(lambda b: decode_batches(b, path), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(table(spark, sf_dir, "documents"), path, pattern), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
