"""What the operators of this subpackage share: scratch tables, streaming over groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_dirs[app]


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder.

    A written table cuts the lineage and survives the loss of executors. Used as a context, all tables but those given to
    ``keep`` are removed at its end, also if it fails; ``drop`` removes a table as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        self._live: dict[str, None] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for path in list(self._live):
            self._delete(path)

    def folder(self) -> str:
        """A path that is free to be written to, removed as a table is."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        self._live[path] = None
        return path

    def put(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes a result: it stays after the end."""
        out = self.put(df)
        self._live.pop(out._scratch_path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        self._live.pop(path, None)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def split_hot(members: DataFrame, key: str, row: str, block: int, scratch: Scratch, weight: Column | None = None, broadcast: int = 100_000) -> DataFrame:
    """Deals the members of each key to groups that one task can hold.

    Adds ``grp`` and ``side``: members of a key of at most ``block`` rows (or sum of ``weight``) are one group (side 2). A larger key
    is split by a hash of the column ``row`` into blocks; each block is a group (side 2), and so are each two blocks (sides 0
    and 1), so any two members of a key are together in exactly one group as (2, 2) or as (0, 1). Keys over ``block`` are rare: they
    are broadcast if there are at most ``broadcast`` of them, else joined by key.
    """
    size = F.sum(weight) if weight is not None else F.count(F.lit(1))
    hot = scratch.put(members.groupBy(key).agg(size.alias("_size")).where(F.col("_size") > block).select(key, F.ceil(F.col("_size") / block).cast("int").alias("_blocks")))
    joined = members.join(F.broadcast(hot) if hot.count() <= broadcast else hot, key, "left")
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    joined = joined.select("*", F.pmod(F.xxhash64(F.lit("block"), row), blocks).cast("int").alias("_mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    side = F.when(low == high, F.lit(2)).when(F.col("_mine") == high, F.lit(1)).otherwise(F.lit(0))
    return joined.select("*", F.xxhash64(key, low, high).alias("grp"), side.cast("int").alias("side")).drop("_blocks", "_mine", "_other")


def whole_groups(work: Callable[[pd.DataFrame], pd.DataFrame], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over partitions sorted by ``key``: hands ``work`` frames that hold
    only complete groups. At most one batch and one group are kept in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            if held and keys[-1] == last:
                held.append(batch)
                continue
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            ready = [*held, batch.iloc[:cut]] if cut else held
            if ready:
                yield work(pd.concat(ready, ignore_index=True) if len(ready) > 1 else ready[0].reset_index(drop=True))
            held, last = [batch.iloc[cut:]], keys[-1]
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return run


def tables_by(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.Table]:
    """For ``mapInArrow`` over rows that lie together by two columns: the rows of each pair of values as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy() for c in (first, second)]
        edges = (np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])) + 1).tolist()
        for low, high in zip([0, *edges], [*edges, batch.num_rows]):
            key = (batch.column(first)[low].as_py(), batch.column(second)[low].as_py())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable by the links a[i]-b[i], for each of n nodes."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def star_links(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links between ids a and b: member, smallest id."""
    nodes = np.unique(np.concatenate([a, b])) if ids is None else ids
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    root = local_components(ia, ib, len(nodes))
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def contracted(stars: DataFrame) -> DataFrame:
    """Links with the components of stars(a, b), b the centre and smaller than a, but few for each node.

    A node that many buckets have linked to their centres keeps the smallest centre; the others are linked to it in its stead, and
    as a family has few centres, most of these links are the same. A node has as many centres as it was in groups, at most."""
    near = stars.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("bs"))
    first = F.get("bs", F.lit(0))
    return near.select(F.explode(F.transform("bs", lambda b, i: F.struct(F.when(i == 0, F.col("a")).otherwise(b).alias("a"), first.alias("b")))).alias("l")).select("l.*").distinct()


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """(node, root) for the nodes of links(a, b), root the smallest node reachable; roots are left out.

    Alternates large-star and small-star steps until the links no longer change. Each step is
    an aggregation with map-side combining and an equality join on the node, so a node with
    very many links is split by the adaptive skew join and never gathered. Each round's links
    are written to the shared folder, which cuts the lineage.
    """
    edges = scratch.put(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _digest(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        after = scratch.put(small)
        scratch.drop(edges)
        edges, before, state = after, state, _digest(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Digests broadcast at most (16 bytes each) to pick the documents whose texts are needed.
BROADCAST_DIGESTS = 500_000


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, text, the rest of ``wanted``) for the digests wanted, from docs(digest, text), once for each."""

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for x in batch["digest"]:
                new.append(x not in seen)
                seen.add(x)
            yield batch[new]
            if len(seen) > 1 << 17:
                seen.clear()

    texts = docs.select("digest", "text")
    ids = wanted.select("digest")
    if wanted.count() <= BROADCAST_DIGESTS:
        texts = texts.join(F.broadcast(ids), "digest", "left_semi")
    texts = texts.mapInPandas(once, "digest binary, text string")
    # copies that other tasks have read: gone behind the join, where equal digests lie together
    return texts.join(wanted, "digest").dropDuplicates(["digest"])


def close_pairs(group: np.ndarray, side: np.ndarray, codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one group (which lie together) whose codes (rows of 64-bit words) differ in at most ``most`` bits.

    Rows of side 2 go with each other, rows of side 0 with those of side 1."""
    lag, at = 1, np.arange(len(group))
    while True:
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]  # a row without a partner at this distance has none further on
        if not len(at):
            return
        differ = sum(np.bitwise_count(codes[at, w] ^ codes[at + lag, w]).astype(np.int16) for w in range(codes.shape[1]))
        near = at[(differ <= most) & ((side[at] != side[at + lag]) | (side[at] == 2))]
        if len(near):
            yield near, near + lag
        lag += 1


def close_stars(frame: pd.DataFrame, group: str, row: str, codes: np.ndarray, most: int, counts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pd.DataFrame:
    """The links of ``close_pairs`` in complete groups, between values of the column ``row``, as spanning stars;
    of the pairs (rows i, j) only those that ``counts``, if given."""
    ids = frame[row].to_numpy()
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i, j in close_pairs(frame[group].to_numpy(), frame["side"].to_numpy(), codes, most):
        if counts is not None:
            own = counts(i, j)
            i, j = i[own], j[own]
        pairs.append((ids[i], ids[j]))
        if sum(len(x[0]) for x in pairs) > 1 << 20:
            pairs = [star_links(None, *map(np.concatenate, zip(*pairs)))]
    a, b = star_links(None, *map(np.concatenate, zip(*pairs)))
    return pd.DataFrame({"a": a, "b": b})


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that a Python worker gets at a time, at most.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows: texts may be long, and both sides hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
