"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints have 64 bits. Two that differ in at most three bits differ in at most one bit
in one of their two halves. So each half is indexed under its 32 one-wildcard variants (one
bit deleted each); an equality on a variant brings every such pair together, and the whole
fingerprints are then verified.

Equal fingerprints are collapsed before the index, so copies never make pairs. A bucket of over ``BLOCK`` fingerprints
is split into blocks, and pairs of blocks are groups of their own. Inside a
group the verified links are reduced to a spanning star at once: what leaves it is
linear in its distinct fingerprints.

``keep_one`` is for a similarity of texts and not for a number of bits: the Jaccard similarity of their sets of ``width`` words
(five) is to be ``similarity`` (0.8) or more. At 0.8 about 15 of 100 bits differ, so fingerprints are wider: ``WIDE`` bits in
``WIDE`` / ``PIECE`` pieces, each indexed under its one-wildcard variants. Pairs up to 23 differing bits (of 192) are met for sure,
others with the probability that one of the twelve pieces differs in at most one bit: at a similarity of exactly 0.8 98 %, at 0.85
99.6 %, at 0.9 99.97 %. Pairs that meet and differ in at most what all but 1 in 10,000 pairs of that similarity do are candidates. Candidates that hang together
are a family; its texts' sets are compared, in blocks, and only links that the sets confirm count.

Defined cases: null or empty text and text without words have fingerprint zero and are
linked like any other (in ``keep_one`` they are one class); fewer words than a shingle has make one shingle; very long texts count
as a whole; repeated rows share a class; null
doc_id takes part but is never a component_id unless a class holds nothing else; of equal texts the smallest doc_id counts. An empty table gives no rows. Extra
columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_DIGESTS, Scratch, close_stars, connected_components, contracted, free_name, split_hot, star_links, table, texts_of, whole_groups

BITS = 64
MAX_DIFFERING = 3
SEED = 42
#: Fingerprints of a bucket that one task compares with each other at most.
BLOCK = 4096
#: Bits of a fingerprint for similarity, and of its pieces.
WIDE, PIECE = 192, 16
_WORDS = tuple(f"c{i}" for i in range(WIDE // 64))
#: Shingles of the texts that one task compares with each other, at most (a text counts as 2,048 at least).
FAMILY = 1 << 21
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of one text; words are split at ASCII white space, A-Z is lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    total, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(part) - width + 1
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> F.Column:
    """Column: the fingerprint as a signed long."""
    return _fingerprints(docs[text])


def _variants(prints: DataFrame) -> DataFrame:
    """(bucket, fp): each half of each fingerprint with one bit deleted."""
    half = lambda i: F.when(i < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    place = F.expr("shiftleft(1L, cast(pmod(i, 32) as int))")
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i")).select(
        F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(half(F.col("i")).bitwiseAND(F.bitwise_not(place))).alias("bucket"), "fp"
    )


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    near = lambda f: close_stars(f, "grp", "fp", f["fp"].to_numpy().view(np.uint64)[:, None], MAX_DIFFERING)
    yield from whole_groups(near, "grp")(batches)


def link(prints: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b) links of distinct fingerprints at most three bits apart, enough to connect every class."""
    members = split_hot(_variants(prints), "bucket", "fp", block, scratch).drop("bucket")
    return members.repartition("grp").sortWithinPartitions("grp").mapInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id."""
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.put(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text).alias("fp")))
        distinct = scratch.put(prints.groupBy("fp").agg(F.min("doc_id").alias("lo")))
        roots = connected_components(link(distinct.select("fp"), scratch, block), scratch)
        member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
        least = member.groupBy("root").agg(F.min("lo").alias("component_id"))
        return scratch.keep(prints.join(member.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"))


# --- similarity of texts -----------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(31) + own[i : i + len(out)])
    return np.unique(out)


def wide_fingerprint(shingles: np.ndarray, bits: int = WIDE) -> np.ndarray:
    """The SimHash of a set, as 64-bit words."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at : at + _BLOCK]
        for w in range(bits // 64):
            own = _mix(part + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64)).view(np.uint8).reshape(-1, 8)
            ones[64 * w : 64 * w + 64] += np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def bits_apart(similarity: float, bits: int = WIDE) -> int:
    """What all but 1 in 10,000 pairs of texts of that Jaccard similarity differ in at most."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi  # sets of equal size; of others the angle is smaller
    return int(min(bits, np.ceil(p * bits + 3.8 * np.sqrt(bits * p * (1 - p)))))


def _sketches(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(x, width) for x in batch["text"]]
        code = np.array([wide_fingerprint(x) for x in sets], np.uint64).reshape(len(sets), len(_WORDS)).view(np.int64)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n": np.array([len(x) for x in sets], np.int64), **{c: code[:, i] for i, c in enumerate(_WORDS)}})


def _pieces(texts: DataFrame) -> DataFrame:
    """(bucket, rid, code): each piece of each fingerprint with one bit deleted."""
    own = texts.select("rid", *_WORDS, F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))).alias("i"))
    value = F.expr(f"shiftrightunsigned(element_at(array({', '.join(_WORDS)}), cast(i div 64 as int) + 1), cast({PIECE} * (i div {PIECE} % {64 // PIECE}) as int)) & {(1 << PIECE) - 1}")
    place = F.expr(f"shiftleft(1L, cast(i % {PIECE} as int))")
    return own.select((F.col("i").cast("long") * (1 << PIECE) + value.bitwiseAND(F.bitwise_not(place))).cast("int").alias("bucket"), "rid", *_WORDS)


def _near_texts(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Links of complete groups. A pair counts where it meets first, so texts that meet in many buckets aren't linked in each."""
    codes = np.stack([frame[c].to_numpy() for c in _WORDS], 1).view(np.uint64)
    variant = frame["variant"].to_numpy()

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = (codes[i] ^ codes[j]).view(np.uint16)
        piece = (np.bitwise_count(differ) <= 1).argmax(1)
        bit = np.maximum(np.log2(np.maximum(differ[np.arange(len(i)), piece], 1)), 0).astype(np.int64)
        return variant[i] == PIECE * piece + bit

    return close_stars(frame, "grp", "rid", codes, most, first)


def _confirmed(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between texts of complete groups whose sets are similar enough, as spanning stars."""
    group = frame["grp"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
        rows = frame.iloc[low:high]
        n, side, rid = high - low, rows["side"].to_numpy(), rows["rid"].to_numpy()
        if n < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size = np.array([len(x) for x in sets])
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), size)
        several = count[column] > 1
        owner, column = owner[several], (np.cumsum(count > 1) - 1)[column[several]]
        both = np.zeros((n, n), np.float64)
        wide, columns = max(4096, (1 << 22) // n), int((count > 1).sum())
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, columns, wide):
            i, j = np.searchsorted(column, [at, at + wide])
            held = np.zeros((n, min(wide, columns - at)), np.float32)
            held[owner[i:j], column[i:j] - at] = 1
            both += held @ held.T
        union = size[:, None] + size - both
        fit = (side[:, None] != side) | (side[:, None] == 2)
        a, b = np.nonzero(np.triu((both >= similarity * union - 1e-9) & fit, 1))
        if len(a):
            x, y = star_links(None, rid[a], rid[b])
            out.append(pd.DataFrame({"a": x, "b": y}))
    return pd.concat(out)


def similar_texts(docs: DataFrame, scratch: Scratch, width: int, similarity: float, doc_id: str, text: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, digest of its text; per distinct text: digest, lo (its smallest doc_id), root (of its class))."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = scratch.put(own.mapInPandas(lambda b: _sketches(b, width), f"doc_id {kind}, digest binary, n long, " + ", ".join(f"{c} long" for c in _WORDS)))
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in _WORDS])
    texts = scratch.put(texts.select("*", F.monotonically_increasing_id().alias("rid")))
    # families of texts whose fingerprints are near each other
    members = split_hot(_pieces(texts), "bucket", "rid", block, scratch)
    members = members.select("rid", *_WORDS, "grp", "side", F.shiftright("bucket", PIECE).cast("int").alias("variant"))
    most = bits_apart(similarity)
    near = whole_groups(lambda f: _near_texts(f, most), "grp")
    stars = members.repartition("grp").sortWithinPartitions("grp").mapInPandas(near, "a long, b long")
    roots = connected_components(contracted(stars), scratch)
    family = roots.select(F.col("node").alias("rid"), "root").unionByName(roots.select(F.col("root").alias("rid"), "root").distinct())
    family = family.join(texts.select("rid", "digest", "n"), "rid")
    family = split_hot(family, "root", "rid", FAMILY, scratch, weight=F.greatest("n", F.lit(2048)))
    wanted = scratch.put(family.groupBy("digest", "rid").agg(F.collect_list(F.struct("grp", "side")).alias("groups")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(g["grp"], g["side"], rid, raw) for t, rid, groups in zip(batch["text"], batch["rid"], batch["groups"]) for raw in [shingle_set(t, width).tobytes()] for g in groups]
            yield pd.DataFrame(rows, columns=["grp", "side", "rid", "shingles"])

    sets = texts_of(own, wanted).mapInPandas(cut, "grp long, side int, rid long, shingles binary")
    links = sets.repartition("grp").sortWithinPartitions("grp").mapInPandas(whole_groups(lambda f: _confirmed(f, similarity), "grp"), "a long, b long")
    classes = connected_components(links, scratch)
    return rows.select("doc_id", "digest"), texts.join(classes, texts["rid"] == classes["node"], "left").select("digest", "lo", F.coalesce("root", "rid").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The documents without near-duplicates: of each class of similar texts the one with the smallest doc_id stays.

    Columns and texts are unchanged. Of repeated rows of that document one stays. Only what goes is joined with the documents: by
    broadcast if there are at most ``BROADCAST_DIGESTS`` such rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, classes = similar_texts(docs, scratch, width, similarity, doc_id, text, block)
        first = classes.groupBy("root").agg(F.min(F.struct(F.col("lo").isNull().alias("none"), "lo", "digest")).alias("first"))
        owner = classes.join(first, "root").select("digest", (F.col("first.digest") == F.col("digest")).alias("stays"), F.col("first.lo").alias("lo"))
        known = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).join(owner, "digest")
        stays = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("lo"))
        marks = scratch.keep(known.select("doc_id", "digest", stays.alias("stays"), "n").where("not stays or n > 1"))
    i, d, s, r = (free_name(docs, x) for x in ("_id", "_digest", "_stays", "_row"))
    marks = marks.select(F.col("doc_id").alias(i), F.col("digest").alias(d), F.col("stays").alias(s))
    if marks.count() <= BROADCAST_DIGESTS:
        marks = F.broadcast(marks)
    same = (F.unhex(F.md5(F.coalesce(docs[text], F.lit("")))) == F.col(d)) & docs[doc_id].eqNullSafe(F.col(i))
    joined = docs.join(marks, same, "left")
    one = Window.partitionBy(i, d).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    repeated = joined.where(F.col(s)).withColumn(r, F.row_number().over(one)).where(F.col(r) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return joined.where(F.col(s).isNull()).select(*columns).unionByName(repeated.select(*columns))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
