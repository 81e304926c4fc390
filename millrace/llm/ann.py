"""Approximate nearest neighbours: neighbour graphs by NN-descent over shards of the table, searched greedily.

Building. The vectors are dealt by hash into shards of ``SHARD`` vectors and ``FLOATS`` components at most, a number that
follows the table; every vector is in one. A shard's graph is made in one task, so what a task holds has a bound, and a vector crosses the
network once. In a shard, ``TREES`` times the vectors are cut in halves by random planes down to ``SLICE`` vectors, and every
vector starts with its ``FIRST`` nearest in each of its slices. That is a start only. A round of NN-descent brings together, at each
vector, those that it has as neighbours or that have it as one, at most ``K`` that are new there and ``K`` that aren't, drawn at random;
pairs with a new one among them are compared, and each gets the other proposed if that is nearer than its farthest neighbour. Of all so
far the nearest ``K`` stay. Rounds end after ``ROUNDS``, or when under ``SETTLED`` of the neighbours changed.

Searching. Every query walks the graph of every shard, and the nearest of all shards are its neighbours. A walk keeps a beam of the
nearest found and in each step looks at the unseen neighbours, in both directions of the graph, of the ``WIDE`` nearest that it hasn't
expanded; it ends when all of the beam are expanded. It starts from the shard's pivots, one in 32 of its vectors and ``PIVOTS`` at most, drawn at random, and one vector
more of each connected part of the graph, so none is out of reach; in its own shard a query starts from its own node too. The beam
begins at ``BEAM``: ``PROBES`` of the queries are compared with all vectors, and the beam is widened until their walks find
``TARGET`` of their neighbours, at any size of the table; the other queries walk with that beam alone. ``looked``
says how many vectors a query was compared with, ``recall`` what the probes found. The distances of the nearest found are computed
again on the original vectors in double precision.

Equal vectors are one node; of each such class the ``k + 1`` smallest ids are kept, as no query can
ask for more, so copies can't crowd out other neighbours.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components and vectors of
another length than the most frequent one take no part, neither as queries nor as candidates; rows of equal vectors
and different ids are candidates of their own, rows that repeat an id and a vector count once; an id with
several vectors is a query for each of them and gets the nearest of all; ties go to the smaller id; with fewer candidates than k all that the walk finds
are returned; rows with null ids are left out; an empty table gives no rows; extra columns (the label) are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, local_components, table, whole_groups

K = 32
ROUNDS = 12
SETTLED = 0.03
TREES = 6
#: Neighbours that a vector starts with from one slice, at most.
FIRST = 16
#: Vectors that are compared with each other at the start, at most.
SLICE = 256
#: Vectors and components of a shard at most; smaller tables are cut into up to SPREAD shards of PART vectors or more, to share the work.
SHARD, FLOATS, SPREAD, PART = 65_536, 1 << 22, 8, 32_768
BEAM = 160
WIDE = 32
#: Vectors of a shard that a walk starts from, at most, besides one of each part of the graph.
PIVOTS = 1024
#: Queries that walk a shard side by side.
SIDE = 128
#: Pairs of a round, and proposals, that are held at a time, about.
PAIRS, PROPOSED = 2_000_000, 1_500_000
#: Queries whose neighbours are found by comparing with all vectors, and the recall of the walks that they must show; the
#: beam is widened up to WIDEST.
PROBES, TARGET, WIDEST = 128, 0.925, 4096


def valid(vector: F.Column) -> F.Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


# --- the graph of a shard ---------------------------------------------------------------


class _Lists:
    """The nearest neighbours found of each vector: ids (-1: none), squared distances, nearest first, and whether they are new."""

    def __init__(self, v: np.ndarray, k: int):
        self.v, self.norm = v, (v**2).sum(1)
        self.ids = np.full((len(v), k), -1, np.int64)
        self.d = np.full((len(v), k), np.inf, np.float32)
        self.new = np.zeros((len(v), k), bool)

    def propose(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> int:
        """Takes b, at distance d, into the list of a where it is among the nearest; how many are."""
        if not len(a):
            return 0
        m, k = self.ids.shape
        touched = np.zeros(m, bool)
        touched[a] = True
        row, c = np.nonzero((self.ids >= 0) & touched[:, None])
        old = len(row)
        a, b = np.concatenate([row, a]), np.concatenate([self.ids[row, c], b])
        d, new = np.concatenate([self.d[row, c], np.maximum(d, 0)]), np.concatenate([self.new[row, c], np.ones(len(d), bool)])
        key = (a * m + b) * 2 + (np.arange(len(a)) >= old)  # of equal ones the first is that of the list
        order = np.argsort(key)
        key = key[order] >> 1
        once = order[np.concatenate([[True], key[1:] != key[:-1]])]
        once = once[np.argsort((a[once] << 32) | d[once].view(np.int32))]  # distances aren't negative, so their bits have their order
        row = a[once]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(begin, np.diff([*begin, len(row)]))
        stay, rank = once[rank < k], rank[rank < k]
        row = a[stay]
        self.ids[row, rank], self.d[row, rank], self.new[row, rank] = b[stay], d[stay], new[stay]
        return int((stay >= old).sum())


def _slices(v: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The rows, halved by planes across two of them each until ``most`` are together."""
    done, open_ = [], [np.arange(len(v))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        x, y = v[rng.choice(rows, 2, replace=False)]
        order = np.argpartition(v[rows] @ (x - y), len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def _start(lists: _Lists, slice_rows: int, rng: np.random.Generator) -> None:
    k = min(lists.ids.shape[1], FIRST)
    for _ in range(TREES):
        found = []
        for rows in _slices(lists.v, slice_rows, rng):
            v, norm = lists.v[rows], lists.norm[rows]
            d = norm[:, None] + norm - 2 * v @ v.T
            np.fill_diagonal(d, np.inf)
            near = np.argpartition(d, min(k, len(rows)) - 1, axis=1)[:, :k]
            best = np.take_along_axis(d, near, 1)
            i, c = np.nonzero(np.isfinite(best))
            found.append((rows[i], rows[near[i, c]], best[i, c]))
        lists.propose(*map(np.concatenate, zip(*found)))


def _drawn(lists: _Lists, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector's neighbours in both directions at most k that are new and k that aren't (-1: none). The new ones that are drawn aren't new any more."""
    m, k = lists.ids.shape
    i, c = np.nonzero(lists.ids >= 0)
    b, new = lists.ids[i, c], lists.new[i, c]
    kind = np.concatenate([i, b]) * 2 + np.concatenate([new, new])
    order = np.argsort(kind << 31 | rng.integers(0, 1 << 31, len(kind)))
    kind = kind[order]
    begin = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, int)
    rank = np.arange(len(kind)) - np.repeat(begin, np.diff([*begin, len(kind)]))
    order, kind, rank = order[rank < k], kind[rank < k], rank[rank < k]
    drawn = np.full((2 * m, k), -1)
    drawn[kind, rank] = np.concatenate([b, i])[order]
    own = order[order < len(i)]
    lists.new[i[own], c[own]] = False
    return drawn[1::2], drawn[::2]


def _round(lists: _Lists, rng: np.random.Generator) -> int:
    """One round of NN-descent: how many neighbours changed."""
    new, old = _drawn(lists, rng)
    size = (new >= 0).sum(1)
    centres = np.flatnonzero(size)
    centres = centres[np.argsort(size[centres], kind="stable")]  # those with as many new ones are compared as one stack
    changed, held, at = 0, [], 0
    while at < len(centres):
        last = min(len(centres), at + max(1, PAIRS // (2 * new.shape[1] ** 2)))
        some, at = centres[at:last], last
        x = new[some, : size[some[-1]]]
        y = np.concatenate([x, old[some]], axis=1)
        far = lists.d[:, -1]
        d = lists.norm[x][:, :, None] + lists.norm[y][:, None, :] - 2 * (lists.v[x] @ lists.v[y].transpose(0, 2, 1))
        pair = (x >= 0)[:, :, None] & (y >= 0)[:, None, :] & (x[:, :, None] != y[:, None, :])
        pair &= np.arange(y.shape[1]) > np.arange(x.shape[1])[:, None]  # two new ones meet once
        g, i, j = np.nonzero(pair & (d < far[x][:, :, None]))
        held.append((x[g, i], y[g, j], d[g, i, j]))
        g, i, j = np.nonzero(pair & (d < far[y][:, None, :]))
        held.append((y[g, j], x[g, i], d[g, i, j]))
        if at == len(centres) or sum(len(h[0]) for h in held) > PROPOSED:
            changed += lists.propose(*map(np.concatenate, zip(*held)))
            held = []
    return changed


def nn_descent(v: np.ndarray, k: int, rounds: int = ROUNDS, slice_rows: int = SLICE) -> np.ndarray:
    """(rows, k): the nearest neighbours found of each row, nearest first, -1 where there are fewer."""
    rng, lists = np.random.default_rng(3), _Lists(v, k)
    _start(lists, slice_rows, rng)
    for _ in range(rounds):
        if _round(lists, rng) < SETTLED * k * len(v):
            break
    return lists.ids


def _both_ways(ids: np.ndarray) -> np.ndarray:
    """(rows, 2 k): the neighbours of each row, and at most k of those that have it as one, those to which it is nearest by rank."""
    m, k = ids.shape
    i, c = np.nonzero(ids >= 0)
    order = np.lexsort((i, c, ids[i, c]))
    b = ids[i, c][order]
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
    rank = np.arange(len(b)) - np.repeat(begin, np.diff([*begin, len(b)]))
    back = np.full((m, k), -1)
    back[b[rank < k], rank[rank < k]] = i[order][rank < k]
    return np.concatenate([ids, back], axis=1).astype(np.int32)


def _shard(frame: pd.DataFrame, k: int, rounds: int, slice_rows: int) -> pd.DataFrame:
    """A row for each shard: its nodes, vectors, links and pivots."""
    out = []
    for shard, rows in frame.groupby("shard", sort=False):
        node, v = rows["node"].to_numpy(), _matrix(rows["v"]).astype(np.float32)
        ids = nn_descent(v, k, rounds, slice_rows)
        i, c = np.nonzero(ids >= 0)
        part = local_components(i, ids[i, c], len(v))
        first = np.unique(part, return_index=True)[1]
        drawn = np.random.default_rng(5).permutation(len(v))[: min(PIVOTS, -(-len(v) // 32))]
        out.append((shard, node.tobytes(), v.tobytes(), _both_ways(ids).tobytes(), np.union1d(first, drawn).astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["shard", "node", "v", "links", "pivots"])


@dataclass(frozen=True)
class Index:
    """shards: a row for each (shard, node, v, links, pivots), as bytes; count of them."""

    shards: DataFrame
    count: int


def shard_count(count: int, dim: int) -> int:
    return max(1, -(-count // SHARD), -(-count * dim // FLOATS), min(SPREAD, count // PART))


def build_graph(nodes: DataFrame, count: int, dim: int, scratch: Scratch, k: int = K, rounds: int = ROUNDS, slice_rows: int = SLICE) -> Index:
    """nodes(node long, v array<float>), count of them -> a graph of each shard of them."""
    n = shard_count(count, dim)
    shard = F.pmod(F.xxhash64("node", F.lit("shard")), F.lit(n)).cast("int")
    dealt = nodes.select(shard.alias("shard"), "node", "v").repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "node")
    made = dealt.mapInPandas(whole_groups(lambda f: _shard(f, k, rounds, slice_rows), "shard"), "shard int, node binary, v binary, links binary, pivots binary")
    return Index(scratch.put(made), n)


# --- search ------------------------------------------------------------------------------


def _squared(x: F.Column, y: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)


def _walk(q: np.ndarray, home: np.ndarray, v: np.ndarray, norm: np.ndarray, links: np.ndarray, pivots: np.ndarray, beam: int, wide: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks of queries q through a shard, home (-1: none) being their own nodes -> the ``keep`` nearest found of each (-1: none), their
    squared distances, and how many vectors were looked at."""
    n, m = len(q), len(v)
    own = (q**2).sum(1)
    seen = np.zeros(n * m, np.int32)
    ids = np.full((n, beam), -1)
    d = np.full((n, beam), np.inf, np.float32)
    spent = np.zeros((n, beam), bool)
    looked = np.zeros(n, np.int64)
    row = np.concatenate([np.repeat(np.arange(n), len(pivots)), np.flatnonzero(home >= 0)])
    node = np.concatenate([np.tile(pivots, n), home[home >= 0]])
    while True:
        # each unseen node once: the last to write its number stays
        place = row * m + node
        free = seen[place] == 0
        row, node, place = row[free], node[free], place[free]
        number = np.arange(1, len(row) + 1, dtype=np.int32)
        seen[place] = number
        last = seen[place] == number
        row, node = row[last], node[last]
        order = np.argsort(row, kind="stable")
        row, node = row[order], node[order]
        count = np.bincount(row, minlength=n)
        looked += count
        far = np.maximum(norm[node] + own[row] - 2 * np.einsum("ij,ij->i", v[node], q[row]), 0)
        walks = np.flatnonzero(count)
        if len(walks):
            begin = np.cumsum(count) - count
            column = np.arange(len(row)) - begin[row]
            at = np.zeros(n, int)
            at[walks] = np.arange(len(walks))
            more, more_d = np.full((len(walks), count.max()), -1), np.full((len(walks), count.max()), np.inf, np.float32)
            more[at[row], column], more_d[at[row], column] = node, far
            all_ids, all_d = np.concatenate([ids[walks], more], axis=1), np.concatenate([d[walks], more_d], axis=1)
            all_spent = np.concatenate([spent[walks], np.zeros(more.shape, bool)], axis=1)
            near = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(all_d, near, 1), axis=1), 1)
            ids[walks], d[walks], spent[walks] = (np.take_along_axis(x, near, 1) for x in (all_ids, all_d, all_spent))
        open_ = (ids >= 0) & ~spent
        open_ &= np.cumsum(open_, axis=1) <= wide
        if not open_.any():
            return ids[:, :keep], d[:, :keep], looked
        spent |= open_
        i, c = np.nonzero(open_)
        wanted = links[ids[i, c]]
        row, node = np.repeat(i, wanted.shape[1]), wanted.reshape(-1).astype(np.int64)
        row, node = row[node >= 0], node[node >= 0]


def walk(index: Index, starts: DataFrame, scratch: Scratch, beam: int, keep: int, wide: int = WIDE) -> DataFrame:
    """Greedy search of all shards for starts(query, q array<float>) -> (query, found: the ``keep`` nearest as (d, node), nearest first, looked:
    how many vectors were compared).

    A shard meets the queries in as many tasks as make use of the cores; a task holds one shard and some queries at a time."""
    cores = starts.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-starts.count() // SIDE), -(-2 * cores // index.count)))
    slots = index.count * parts
    slot = lambda part: (F.col("shard") * parts + part).cast("int").alias("slot")
    shards = index.shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(slot(F.col("part")), F.lit(0).cast("long").alias("query"), F.lit(None).cast("array<float>").alias("q"), "node", "v", "links", "pivots")
    none = [F.lit(None).cast("binary").alias(c) for c in ("node", "v", "links", "pivots")]
    asked = starts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.count - 1)))).select(slot(F.pmod(F.xxhash64("query"), F.lit(parts))), "query", "q", *none)
    met = shards.unionByName(asked).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", F.col("q").isNotNull())  # a null query would make floats of the ids in pandas

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            bounds = np.flatnonzero(batch["node"].notna().to_numpy())
            for low, high in zip([0, *bounds], [*bounds, len(batch)]):
                rows = batch.iloc[low:high]
                if len(rows) and rows["node"].iloc[0] is not None:
                    one, rows = rows.iloc[0], rows.iloc[1:]
                    node = np.frombuffer(one["node"], np.int64)
                    v = np.frombuffer(one["v"], np.float32).reshape(len(node), -1)
                    shard = v, (v**2).sum(1), np.frombuffer(one["links"], np.int32).reshape(len(node), -1), np.frombuffer(one["pivots"], np.int64)
                for at in range(0, len(rows), SIDE):
                    some = rows.iloc[at : at + SIDE]
                    query = some["query"].to_numpy().astype(np.int64)
                    home = np.minimum(np.searchsorted(node, query), len(node) - 1)  # nodes lie in order
                    home = np.where(node[home] == query, home, -1)
                    ids, d, looked = _walk(_matrix(some["q"]), home, *shard, beam, wide, keep)
                    yield pd.DataFrame({"query": query, "node": [node[x[x >= 0]] for x in ids], "d": [y[x >= 0] for x, y in zip(ids, d)], "looked": looked})

    found = met.mapInPandas(run, "query long, node array<long>, d array<float>, looked long")
    near = F.arrays_zip(F.col("d"), F.col("node"))
    found = found.groupBy("query").agg(F.flatten(F.collect_list(near)).alias("found"), F.sum("looked").alias("looked"))
    return scratch.put(found.select("query", F.slice(F.array_sort("found"), 1, keep).alias("found"), "looked"))


def exact_lists(nodes: DataFrame, probes: pd.DataFrame, k: int) -> DataFrame:
    """(query, node): the k nearest nodes of each probe (query, q), itself left out, by comparing it with all of nodes(node, v).

    Probes are few and go to all tasks; a task sends back its k nearest of each."""
    query, q = probes["query"].to_numpy(), _matrix(probes["q"]).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, ids = np.full((len(q), k), np.inf, np.float32), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            v, node = _matrix(batch["v"]), batch["node"].to_numpy()
            d = np.maximum((v**2).sum(1) + (q**2).sum(1)[:, None] - 2 * q @ v.T, 0)
            d[query[:, None] == node] = np.inf
            d, of = np.concatenate([best, d], axis=1), np.concatenate([ids, np.broadcast_to(node, d.shape)], axis=1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            best, ids = np.take_along_axis(d, near, 1), np.take_along_axis(of, near, 1)
        i, c = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"query": query[i], "node": ids[i, c], "d": best[i, c]})

    nearest = Window.partitionBy("query").orderBy("d", "node")
    found = nodes.select("node", "v").mapInPandas(run, "query long, node long, d float")
    return found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).select("query", "node")


def _recall(reached: DataFrame, truth: DataFrame, k: int) -> float:
    """The share of truth(query, node) among the k first that the walks of its queries have found, themselves left out."""
    other = F.slice(F.filter("found", lambda f: f["node"] != F.col("query")), 1, k)
    found = reached.select("query", F.explode(other).alias("f")).select("query", F.col("f.node").alias("node"))
    total = truth.count()
    return truth.join(found, ["query", "node"]).count() / total if total else 1.0


def walk_until(index: Index, starts: DataFrame, nodes: DataFrame, scratch: Scratch, beam: int, k: int) -> tuple[DataFrame, float, int]:
    """``walk`` with a beam under which PROBES of the queries have a recall of TARGET, measured against all vectors: (walks, recall, beam).

    The probes, the queries with the smallest hashes, are walked alone until their beam suffices. What a beam misses falls
    about as the beam grows, which gives the next one to try."""
    probes = starts.select("query", "q").orderBy(F.xxhash64("query", F.lit("probe")), "query").limit(PROBES).toPandas()
    if not len(probes):
        return walk(index, starts, scratch, beam, 2 * k), 1.0, beam
    truth = scratch.put(exact_lists(nodes, probes, k))
    every = starts.count() <= len(probes)
    probe = F.col("query").isin(probes["query"].tolist())
    few = starts if every else starts.where(probe)
    while True:
        reached = walk(index, few, scratch, beam, 2 * k)
        recall = _recall(reached, truth, k)
        if recall >= TARGET or beam >= WIDEST:
            break
        scratch.drop(reached)
        beam = min(WIDEST, math.ceil(beam * min(4, max(1.3, 1.1 * ((1 - recall) / (1 - TARGET)) ** 1.1))))
    if not every:  # the probes have walked with this beam already
        rest = walk(index, starts.where(~probe), scratch, beam, 2 * k)
        both = scratch.put(reached.unionByName(rest))
        scratch.drop(reached, rest)
        reached = both
    scratch.drop(truth)
    return reached, recall, beam


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", beam: int = BEAM, slice_rows: int = SLICE) -> DataFrame:
    """The k nearest rows of ``vectors`` found for each row of ``queries`` (query id and vector under the same
    names), itself left out: query_id, rank, vec_id, score, looked, recall (as measured on a sample of the queries)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = clean(vectors)
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, looked long, recall double")
    dim = dim[0]["dim"]
    digest = F.unhex(F.md5(F.array_join(F.col("v"), ",").cast("binary")))
    own = lambda df: df.where(F.size("v") == dim).select("id", "v", digest.alias("digest"))
    rows, asked = own(rows), own(clean(queries))
    # classes of equal vectors: a node each, with the ids that a query can ask for
    node = F.xxhash64("digest").alias("node")
    smallest = Window.partitionBy("digest").orderBy("id")
    ids = rows.select("digest", "id").distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    ids = scratch.put(ids.groupBy(node).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    nodes = scratch.put(rows.groupBy("digest").agg(F.first("v").alias("v")).select(node, "v"))
    count, distinct = nodes.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if distinct < count:
        raise RuntimeError("two vectors share a hash")
    short = nodes.select("node", F.col("v").cast("array<float>").alias("v"))
    index = build_graph(short, count, dim, scratch, slice_rows=slice_rows)
    # queries of equal vectors walk once
    classes = scratch.put(asked.groupBy("digest").agg(F.first("v").alias("q")).select(F.xxhash64("digest").alias("query"), "q"))
    member = scratch.put(asked.select(F.xxhash64("digest").alias("query"), F.col("id").alias("query_id")).distinct())
    asking = classes.select("query", F.col("q").cast("array<float>").alias("q"))
    reached, recall, _ = walk_until(index, asking, short, scratch, max(beam, 2 * k), k)
    # every distance again, on the original vectors
    found = reached.select("query", "looked", F.posexplode(F.transform(F.slice("found", 1, 2 * k), lambda f: f["node"])).alias("_", "node"))
    exact = found.join(nodes, "node").join(classes, "query").select("query", "looked", "node", F.sqrt(_squared(F.col("q"), F.col("v"))).alias("score"))
    near = exact.join(ids, "node").join(member, "query").select("query_id", "score", "looked", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("looked").alias("looked"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = scratch.put(ranked)
    scratch.drop(ids, nodes, index.shards, classes, member, reached)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "looked", F.lit(float(recall)).alias("recall"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def brute_force(ids: list[int], vectors: np.ndarray, queries: list[int], k: int = 10) -> dict[int, list[tuple[int, float]]]:
    out = {}
    ids_array = np.asarray(ids)
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids_array, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], float(d[j])) for j in order]
    return out
