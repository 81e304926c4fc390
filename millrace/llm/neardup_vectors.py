"""Near-duplicate embeddings through randomised-rotation binary codes.

Each distinct vector is normalised, rotated by a random orthonormal map into ``CODE_BITS``
dimensions and reduced to its signs. With the code the index stores the correction factor
f = <signs / sqrt(D), rotated vector>. For a code and another unit vector y,

    <signs / sqrt(D), rotated y> / f

estimates the inner product without bias. Of y the index holds its rotated components on a scale of 16 steps, rounded with a
dither, as four bit planes, so the estimate takes XOR and popcount of 64-bit words only; its error is at most

    BOUND * sqrt((1 - f^2) / (f^2 * (D - 1)) + step^2 / (4 f^2))

but for a chance that falls with the square of BOUND (5: under one in a million pairs). A pair
whose upper bound is below the threshold is decided. Vectors of pairs that aren't are fetched, and these pairs are recomputed from the
original vectors in double precision. The bound is used without the factor sqrt(1 - s^2), so it is
on the safe side. What travels to a bucket is a vector's code and planes, 160 bytes at any dimension, and not its components.

Candidates. A table's bucket is a part of the code's bits. Two vectors with cosine 0.9 differ
in a bit with probability arccos(0.9) / pi = 0.144, and as many tables are built as bring such a
pair together with probability ``1 - MISS``, averaged over how many bits of the code it differs in. A pair is looked at in the first table that brings it
together and nowhere else, so nothing is counted twice. A bucket over ``BLOCK`` vectors is split
into blocks, and pairs of blocks are groups of their own; a task holds two blocks at most.

Pairs never leave a group: it gives each vector's number of links and a spanning star of the links.

Equal vectors are collapsed first and counted, so copies make no pairs.

Defined cases: null or empty vectors, zero vectors, vectors with null or non-finite components
and vectors of another length than the most frequent one link with nothing; repeated rows are
vectors of their own; null vec_id takes part; an empty table gives no rows; extra columns (the label) are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, split_hot, star_links, table, whole_groups

THRESHOLD = 0.9
CODE_BITS = 256
BOUND = 5.0
MISS = 1e-4
#: Bits in which the rotated components are held.
PLANES = 4
BLOCK = 2048
#: Vectors that a bucket should hold.
_FILL = 256


def valid(vector: F.Column) -> F.Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """dim x bits, with orthonormal rows."""
    bits = max(bits, dim)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))[0].T.copy()


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as bits, correction factors) of unit vectors."""
    turned = vectors @ turn
    return turned > 0, np.abs(turned).sum(1) / math.sqrt(turn.shape[1])


def quantise(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes: rows x PLANES x 64-bit words, lowest values, steps) of rotated vectors."""
    low = turned.min(1)
    step = (turned.max(1) - low) / ((1 << PLANES) - 1)
    dither = np.random.default_rng(13).random(turned.shape[1])
    level = np.floor((turned - low[:, None]) / step[:, None] + dither).clip(0, (1 << PLANES) - 1).astype(np.uint8)
    return np.stack([words(level >> b & 1) for b in range(PLANES)], axis=1), low, step


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words; the last is filled up with zeros."""
    short = -bits.shape[1] % 64
    return np.packbits(np.pad(bits.astype(np.uint8), ((0, 0), (0, short))), axis=1).view(np.uint64)


def estimate(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """Estimated inner products of coded vectors (rows) with quantised ones (columns), by XOR and popcount."""
    ones = np.bitwise_count(code).sum(1, dtype=np.int32)
    # <signs, plane> = popcount(code) - popcount(code ^ plane)
    differ = np.zeros((len(code), len(planes)), np.int32)
    for b in range(PLANES):
        for w in range(code.shape[1]):
            differ += np.bitwise_count(code[:, None, w] ^ planes[None, :, b, w]).astype(np.int32) << b
    levels = ones[:, None] * ((1 << PLANES) - 1) - differ
    return (low * (2 * ones - bits)[:, None] + step * levels) / (math.sqrt(bits) * factor)[:, None]


def error_bound(factors: np.ndarray, bits: int, step: np.ndarray | float = 0.0, bound: float = BOUND) -> np.ndarray:
    return bound * np.sqrt((1 - factors**2) / (factors**2 * (bits - 1)) + step**2 / (4 * factors**2))


def missed(bits: int, tables: int, threshold: float, width: int = CODE_BITS) -> float:
    """Chance that a pair at the threshold meets in no table, over the number of bits in which its codes differ.

    All tables take their bits from one code, so pairs that differ in many bits are missed by all of them more often."""
    differ = math.acos(threshold) / math.pi
    out = 0.0
    for d in range(width + 1):
        weight = math.exp(math.lgamma(width + 1) - math.lgamma(d + 1) - math.lgamma(width - d + 1) + d * math.log(differ) + (width - d) * math.log1p(-differ))
        out += weight * (1 - math.comb(width - d, bits) / math.comb(width, bits)) ** tables
    return out


def plan_tables(n: int, threshold: float, miss: float = MISS, width: int = CODE_BITS) -> tuple[int, int]:
    """(bits of a table, tables) for n vectors."""
    bits = min(24, max(4, round(math.log2(max(n, 1) / _FILL)) if n > _FILL else 4))
    few, enough = 0, 1
    while missed(bits, enough, threshold, width) > miss:
        few, enough = enough, 2 * enough
    while enough - few > 1:
        middle = (few + enough) // 2
        few, enough = (few, middle) if missed(bits, middle, threshold, width) <= miss else (middle, enough)
    return bits, enough


def _table_bits(bits: int, tables: int, width: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.array([np.sort(rng.choice(width, bits, replace=False)) for _ in range(tables)])


_CODED = "cid long, code binary, planes binary, factor double, low double, step double, buckets array<long>"


def _unit(column: pd.Series) -> np.ndarray:
    raw = np.stack(column.to_numpy()).astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def _code_rows(batches: Iterator[pd.DataFrame], dim: int, bits: int, tables: int) -> Iterator[pd.DataFrame]:
    turn = rotation(dim, CODE_BITS)
    picks = _table_bits(bits, tables, turn.shape[1])
    weights = 1 << np.arange(bits)
    for batch in batches:
        unit = _unit(batch["v"])
        signs, factors = encode(unit, turn)
        planes, low, step = quantise(unit @ turn)
        keys = (signs[:, picks] * weights).sum(2) + (np.arange(tables) << bits)
        yield pd.DataFrame({"cid": batch["cid"], "code": [x.tobytes() for x in words(signs)], "planes": [x.tobytes() for x in planes], "factor": factors, "low": low, "step": step, "buckets": list(keys)})


class _Group:
    """The members of one complete group and which of their pairs the codes leave undecided."""

    def __init__(self, frame: pd.DataFrame, threshold: float, width: int, picks: np.ndarray):
        self.side, self.tab, self.n = frame["side"].to_numpy(), int(frame["tab"].iloc[0]), len(frame)
        self.code = np.frombuffer(b"".join(frame["code"]), np.uint64).reshape(self.n, -1)
        self.planes = np.frombuffer(b"".join(frame["planes"]), np.uint64).reshape(self.n, PLANES, -1)
        self.factor, self.low, self.step = (frame[c].to_numpy() for c in ("factor", "low", "step"))
        self.threshold, self.width = threshold, width
        bits = np.unpackbits(self.code.view(np.uint8), axis=1)[:, :width]
        # an earlier table may have brought a pair together
        self.earlier = (bits[:, picks[: self.tab]] * (1 << np.arange(picks.shape[1]))).sum(2)

    def open_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # side 2: one block with itself; sides 0 and 1: two blocks
        alone = self.side[0] == 2
        first, second = (np.arange(self.n),) * 2 if alone else (np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1))
        wide = max(1, (1 << 19) // max(1, len(second)))
        for some in range(0, len(first), wide):
            rows = first[some : some + wide]
            about = estimate(self.code[rows], self.factor[rows], self.planes[second], self.low[second], self.step[second], self.width)
            least = self.threshold - error_bound(self.factor[rows][:, None], self.width, self.step[second][None, :]) - 1e-6
            i, j = np.nonzero(about >= least)
            i, j = rows[i], second[j]
            if alone:
                i, j = i[i < j], j[i < j]
            if self.tab and len(i):
                new = ~(self.earlier[i] == self.earlier[j]).any(1)
                i, j = i[new], j[new]
            yield i, j


def _each(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    group = frame["grp"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for low, high in zip(starts, [*starts[1:], len(frame)]):
        if high - low > 1:
            yield frame.iloc[low:high]


def _undecided(frame: pd.DataFrame, threshold: float, width: int, picks: np.ndarray) -> pd.DataFrame:
    """The members of complete groups that have a pair which the codes leave open."""
    out = [frame.iloc[:0]]
    for rows in _each(frame):
        marked = np.zeros(len(rows), bool)
        for i, j in _Group(rows, threshold, width, picks).open_pairs():
            marked[i] = marked[j] = True
        out.append(rows[marked])
    return pd.concat(out)[["grp", "cid", "side", "tab"]]


def _exact(frame: pd.DataFrame, threshold: float, width: int, picks: np.ndarray) -> pd.DataFrame:
    """Counts of links (a = b) and spanning stars of complete groups, from the vectors in double precision."""
    out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})]
    for rows in _each(frame):
        cid, copies, unit = rows["cid"].to_numpy(), rows["copies"].to_numpy(), _unit(rows["v"])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in _Group(rows, threshold, width, picks).open_pairs():
            for some in range(0, len(i), 1 << 16):
                x, y = i[some : some + (1 << 16)], j[some : some + (1 << 16)]
                sure = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                a.append(x[sure])
                b.append(y[sure])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            count = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
            some = np.flatnonzero(count)
            x, y = star_links(None, cid[a], cid[b])
            out += [pd.DataFrame({"a": cid[some], "b": cid[some], "n": count[some].astype(np.int64)}), pd.DataFrame({"a": x, "b": y, "n": np.zeros(len(x), np.int64)})]
    return pd.concat(out)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.when(valid(F.col("v")), F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))  # -0.0 is 0.0
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sizes[0]["dim"]
    # a class of equal vectors is known by a digest; its cid stands for it in the graph
    digest = F.when(F.size("v") == dim, F.unhex(F.md5(F.array_join(F.col("v"), ",").cast("binary"))))
    marked = rows.select("vec_id", F.when(F.size("v") == dim, F.col("v")).alias("v"), digest.alias("digest"))
    with Scratch(spark) as scratch:
        classes = marked.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lo"), F.first("v").alias("v"))
        classes = scratch.put(classes.select("*", F.xxhash64("digest").alias("cid")))
        width = max(CODE_BITS, dim)
        bits, tables = plan_tables(classes.count(), threshold, width=width)
        picks = _table_bits(bits, tables, width)
        coded = scratch.put(classes.select("cid", "v").mapInPandas(lambda b: _code_rows(b, dim, bits, tables), _CODED))
        codes = coded.drop("buckets")
        member = split_hot(coded.select("cid", F.explode("buckets").alias("bucket")), "bucket", "cid", block, scratch)
        member = member.select("cid", "grp", "side", F.shiftright("bucket", bits).cast("int").alias("tab"))
        near = whole_groups(lambda f: _undecided(f, threshold, width, picks), "grp")
        left = scratch.put(member.join(codes, "cid").repartition("grp").sortWithinPartitions("grp").mapInPandas(near, "grp long, cid long, side int, tab int"))
        exact = whole_groups(lambda f: _exact(f, threshold, width, picks), "grp")
        fetched = left.join(codes, "cid").join(classes.select("cid", "copies", "v"), "cid")
        found = scratch.put(fetched.repartition("grp").sortWithinPartitions("grp").mapInPandas(exact, "a long, b long, n long"))
        counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
        roots = connected_components(found.where("a <> b").select("a", "b"), scratch)
        c = classes.select("cid", "digest", "copies", "lo")
        done = c.join(counts, c["cid"] == counts["a"], "left").join(roots, c["cid"] == roots["node"], "left")
        done = done.select("digest", "lo", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "cid").alias("root"))
        least = done.groupBy("root").agg(F.min("lo").alias("component_id"))
        done = scratch.keep(done.join(least, "root").select("digest", "n_links", "component_id"))
    out = marked.select("vec_id", "digest").join(done, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id)::BIGINT AS n_links,
       r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
