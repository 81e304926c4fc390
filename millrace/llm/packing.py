"""Packing by power-of-two decomposition.

A document's ids are cut, from its start, into pieces of the sequence length and then into
the binary digits of what is left, largest first: 1,500 ids give 1,024 + 256 + 128 + 64 + 16 +
8 + 4. Every piece is a sequence of its own whose length is a power of two, so there is no
padding and no sequence crosses documents. ``bucket`` is the binary logarithm of the length;
a training batch is drawn from one bucket, and ``write_buckets`` lays the pieces out that way.

The work is a map over the rows as they are read: no shuffle, and no key that could be hot.
A sequence_id is the number of the read task and the row's place in it, so a task that is run
again after a loss gives the same numbers.

Ids are those of the library tokenizers for the given file with its default settings: strings
of special tokens in a text become those tokens. For a file whose merges are in the order of
its ids, which is checked as it is loaded, tiktoken gives the same ids four times as fast and is used, but for texts with
so much white space at a stretch that its matcher would overflow.

Defined cases: null text is empty and packs its end id alone; repeated rows are packed again,
each under its own sequences; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import long_space
from .common import table

LENGTH = 1024
END_ID = 0


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


@cache
def _encode(path: str, pattern: str):
    """Text to ids for a byte-level tokenizers file."""

    @cache
    def tokenizer():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    slow = lambda text: tokenizer().encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, special = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    plain = spec.get("normalizer") is None and not (spec.get("pre_tokenizer") or {}).get("add_prefix_space") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    if plain and made == sorted(made):
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: slow(text) if long_space(text) else fast.encode(text, allowed_special="all")
    return slow


def decompose(n: int, length: int = LENGTH) -> list[int]:
    """Piece lengths for n ids: as many of the sequence length as fit, then the binary digits of the rest."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, pattern: str, length: int) -> Iterator[pa.RecordBatch]:
    encode = _encode(path, pattern)
    for batch in batches:
        for some in range(0, batch.num_rows, 512):
            part = batch.slice(some, 512)
            doc, start, size, total, raw = [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                ids = np.array([*(encode(text) if text else ()), END_ID], dtype="<u4").tobytes()
                n, at = len(ids) // 4, 0
                for m in decompose(n, length):
                    doc.append(i)
                    start.append(at)
                    size.append(m)
                    total.append(n)
                    raw.append(ids[4 * at : 4 * (at + m)])
                    at += m
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc, pa.int32())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit),
    bucket, sequence_id, offset. ``length`` must be a power of two."""
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.mapInArrow(lambda b: _pieces(b, path, pattern, length), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return pieces.select(
        "*", F.round(F.log2("length")).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences by bucket: equal lengths lie together."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))
