"""Merkle manifests of a dataset: a tree of digests per source, and one over the sources.

Leaves are numbered within their source by a range partitioning and counts per range, so a source of any size is spread over
tasks. Trees are built event-driven: a task gives each node that it has to a partial parent, which is held under its key (tree,
level, number) and accumulates the indexed digests of its children in any order; once it holds as many as the size of the tree
says, it is hashed and given on to its own parent. What remains at the end of a task, the frontier, is reshuffled by an ancestor
that lies some levels higher and climbs on there, until no node waits. Each finished parent leaves a reverse link to its
children. Proofs follow these links from the roots down, in strides of STRIDE levels: a task gets the subtree of one node with
at most 3 ** STRIDE leaves, and the proof of that node.

A proof is an array of (left, right) from a leaf to the root: the digests of a node's siblings before and after it, joined.

Defined cases: null in any column is ``-`` in a leaf; null source is a tree of its own and the first one; null doc_id comes first;
equal doc_ids are ordered by leaf, and rows that are equal in all columns are leaves of their own; a single leaf is its own
subroot, a single source's subroot the root; a lone child's run has no siblings, its proof holds two empty strings there; an empty table
has no root and gives no rows; a text of any length is hashed where it is read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, tables_by

ARITY, STRIDE = 3, 7
#: Leaves of a range, about; levels that a reshuffle of the frontier looks up at a time.
RANGE_ROWS, RISE = 16_384, 3
#: Rows of counts and trees broadcast at most.
BROADCAST_ROWS = 200_000
#: The tree over the sources; a source's tree is ``s`` and its name, that of no source is empty.
TOP = "t"

NODES = "tree string, n long, level int, idx long, digest string, children array<string>, root boolean"
PROOF = "array<struct<left:string,right:string>>"


def leaf_digest(*columns: Column | str) -> Column:
    """sha256 of the columns: each ``-`` if null, else its length in bytes, a colon and the value."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _joined(left: DataFrame, right: DataFrame, on: list[str], n: int) -> DataFrame:
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Adds ``idx``, a row's place in its tree, and ``n``, the size of the tree; with (tree, n) of each tree and the number of runs.

    Rows are cut into ranges of their order; a run is the part of a tree in a range."""
    n = rows.count()
    tie = F.monotonically_increasing_id()
    ranged = rows.withColumn("_tie", tie).repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), "tree", *[F.col(c).asc_nulls_first() for c in order], "_tie")
    ranged = scratch.put(ranged.withColumn("_run", F.spark_partition_id()))
    before = Window.partitionBy("tree").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("tree", "_run").agg(F.count(F.lit(1)).alias("own"))
    runs = scratch.put(runs.select("tree", "_run", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"), F.sum("own").over(Window.partitionBy("tree")).alias("n")))
    within = Window.partitionBy("tree", "_run").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_tie")
    placed = ranged.withColumn("_at", F.row_number().over(within) - 1)
    k = runs.count()
    out = _joined(placed, runs, ["tree", "_run"], k).withColumn("idx", (F.col("start") + F.col("_at")).cast("long")).drop("_tie", "_run", "_at", "start")
    return out, runs.select("tree", "n").distinct(), k


def _climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gives nodes to their partial parents; yields finished parents with their children, roots, and at last the frontier."""
    partial: dict[tuple, tuple[int, dict[int, str]]] = {}
    names = [f.split()[0] for f in NODES.split(", ")]
    for batch in batches:
        out = []
        for tree, n, level, idx, digest in zip(batch["tree"], batch["n"].tolist(), batch["level"].tolist(), batch["idx"].tolist(), batch["digest"]):
            size = -(-n // ARITY**level)
            if size == 1:
                out.append((tree, n, level, idx, digest, None, True))
            while size > 1:
                key = (tree, level + 1, idx // ARITY)
                children = partial.setdefault(key, (n, {}))[1]
                children[idx] = digest
                if len(children) < min(ARITY, size - ARITY * key[2]):
                    break
                del partial[key]
                held = [children[i] for i in sorted(children)]
                digest, level, idx, size = hashlib.sha256("".join(held).encode()).hexdigest(), level + 1, key[2], -(-size // ARITY)
                out.append((tree, n, level, idx, digest, held, size == 1))
        if out:
            yield pd.DataFrame(out, columns=names)
    rest = [(tree, n, level - 1, i, digest, None, False) for (tree, level, _), (n, children) in partial.items() for i, digest in children.items()]
    for low in range(0, len(rest), 1000):
        yield pd.DataFrame(rest[low : low + 1000], columns=names)


def grow(nodes: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """The finished parents and the roots above nodes(tree, n, level, idx, digest) that complete their trees.

    ``height``: levels that most tasks can climb by themselves."""
    done = []
    while True:
        got = scratch.put(nodes.select("tree", "n", "level", "idx", "digest").mapInPandas(_climb, NODES))
        done.append(got.where("root or children is not null"))
        waiting = got.where("not root and children is null")
        if not waiting.limit(1).count():
            break
        height += RISE
        up = F.greatest(F.lit(height) - F.col("level"), F.lit(1))
        nodes = waiting.withColumn("_up", up).repartition("tree", F.expr(f"idx div cast(pow({ARITY}, _up) as bigint)"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _descend(low: int):
    """Proofs of the nodes of level ``low`` (leaves: of the rows of kind 2) of each (tree, block), from the links above them and the proof of its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tables_by(batches, "tree", "block"):
            kind, idx = part.column("kind").to_numpy(), part.column("idx").to_numpy()
            top = int(np.flatnonzero(kind == 0)[0])
            above, subroot = part.column("proof")[top].as_py(), part.column("subroot")[top].as_py()
            links = np.flatnonzero(kind == 1)
            level = part.column("level").to_numpy()
            left, right, places = [], [], []  # of all nodes below a link; for a level, where its nodes begin and their first number
            for at in range(low + 1, int(level[links].max()) + 1 if len(links) else low + 1):
                rows = links[level[links] == at]
                rows = rows[np.argsort(idx[rows])]
                places.append((len(left), ARITY * int(idx[rows[0]])))
                for children in part.column("children").take(pa.array(rows)).to_pylist():
                    for i in range(len(children)):
                        left.append("".join(children[:i]))
                        right.append("".join(children[i + 1 :]))
            if low == 0:
                own = np.flatnonzero(kind == 2)
                nodes = idx[own]
            elif places:
                end = places[1][0] if len(places) > 1 else len(left)
                nodes = np.arange(places[0][1], places[0][1] + end)
            else:
                continue
            upper = len(left)
            left += [a["left"] for a in above]
            right += [a["right"] for a in above]
            steps = [start + nodes // ARITY**k - first for k, (start, first) in enumerate(places)]
            steps += [np.full(len(nodes), upper + k) for k in range(len(above))]
            take = pa.array(np.stack(steps, axis=1).ravel() if steps else np.empty(0, np.int64))
            # offsets of a batch stay below two gigabytes
            width, count = len(steps), len(nodes)
            pairs = pa.array(left, pa.string()), pa.array(right, pa.string())
            for lo in range(0, count, 1000):
                hi = min(count, lo + 1000)
                piece = take[lo * width : hi * width]
                flat = pa.StructArray.from_arrays([p.take(piece) for p in pairs], names=["left", "right"])
                proof = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * width, pa.int32()), flat)
                columns = {"tree": pa.array([part.column("tree")[0].as_py()] * (hi - lo)), "idx": pa.array(nodes[lo:hi]), "proof": proof, "subroot": pa.array([subroot] * (hi - lo), pa.string())}
                if low == 0:
                    columns["item"] = part.column("item").take(pa.array(own[lo:hi])).combine_chunks()
                yield from pa.table(columns).to_batches()

    return run


def prove(leaves: DataFrame, links: DataFrame, roots: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """Proofs of leaves(tree, idx, item) from the reverse links of their trees: tree, idx, proof, subroot, item.

    ``roots``: tree, n, proof (from the root of the tree on upwards), subroot; ``largest``: the size of the largest tree."""
    item = leaves.schema["item"].dataType.simpleString()
    block = lambda high: F.expr(f"idx div cast(pow({ARITY}, greatest({high} - level, 0)) as bigint)").alias("block")
    height = F.ceil(F.log(F.col("n").cast("double")) / math.log(ARITY) - 1e-9)
    # floating logarithms are corrected by comparing exact powers
    height = F.when(F.pow(F.lit(float(ARITY)), height) < F.col("n"), height + 1).otherwise(height)
    starts = roots.select("tree", F.greatest(F.ceil(height / STRIDE) - 1, F.lit(0)).cast("int").alias("stride"), "proof", "subroot")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    carried = None
    levels = 0
    while ARITY**levels < largest:
        levels += 1
    for stride in range(max(0, math.ceil(levels / STRIDE) - 1), -1, -1):
        low, high = stride * STRIDE, (stride + 1) * STRIDE
        tops = starts.where(F.col("stride") == stride).select("tree", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(high).alias("level"), F.lit(0).cast("long").alias("idx"), none("array<string>", "children"), "proof", "subroot", none(item, "item"))
        if carried is not None:
            tops = tops.unionByName(carried.select("tree", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.lit(high).alias("level"), "idx", none("array<string>", "children"), "proof", "subroot", none(item, "item")))
        rows = tops.unionByName(links.where((F.col("level") > low) & (F.col("level") <= high)).select("tree", block(high), F.lit(1).alias("kind"), "level", "idx", "children", none(PROOF, "proof"), none("string", "subroot"), none(item, "item")))
        if not stride:
            rows = rows.unionByName(leaves.withColumn("level", F.lit(0)).select("tree", block(high), F.lit(2).alias("kind"), "level", "idx", none("array<string>", "children"), none(PROOF, "proof"), none("string", "subroot"), "item"))
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind")
        out = rows.mapInArrow(_descend(low), f"tree string, idx long, proof {PROOF}, subroot string" + ("" if stride else f", item {item}"))
        if stride:
            carried = scratch.put(out)
    return out


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, scratch: Scratch, tree: str = "source", order: str = "doc_id") -> tuple[DataFrame, str | None]:
    """For leaves(source, doc_id, leaf, more columns) each row with its proof and subroot, and the root of all."""
    names = [c for c in leaves.columns if c != tree]
    rows = scratch.put(leaves.select(F.coalesce(F.concat(F.lit("s"), F.col(tree)), F.lit("")).alias("tree"), F.col(order).alias("_order"), F.col("leaf").alias("_leaf"), F.struct(tree, *names).alias("item")))
    placed, trees, runs = numbered(rows, ["_order", "_leaf"], scratch)
    placed = scratch.put(placed)
    trees = scratch.put(trees)
    count, largest, total = trees.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if not count:
        return leaves.withColumns({"proof": F.lit(None).cast(PROOF), "subroot": F.lit(None).cast("string")}), None
    nodes = placed.select("tree", "n", F.lit(0).alias("level"), "idx", F.col("_leaf").alias("digest"))
    run_height = max(1, round(math.log(max(1, total / runs), ARITY)))
    links = grow(nodes, run_height, scratch)
    ranked, _, _ = numbered(trees.select(F.lit(TOP).alias("tree"), F.col("tree").alias("own"), F.col("n").alias("size")), ["own"], scratch)
    ranked = scratch.put(ranked)
    subroots = _joined(links.where("root").select(F.col("tree").alias("own"), F.col("digest").alias("subroot")), ranked, ["own"], count)
    subroots = scratch.put(subroots)
    upper = grow(subroots.select(F.lit(TOP).alias("tree"), "n", F.lit(0).alias("level"), "idx", F.col("subroot").alias("digest")).repartition(F.expr(f"idx div {ARITY ** STRIDE}")), STRIDE, scratch)
    root = upper.where("root").first()["digest"]
    empty = F.expr(f"cast(array() as {PROOF})")
    over = prove(
        subroots.select(F.lit(TOP).alias("tree"), "idx", F.struct("own", "size", "subroot").alias("item")), upper.where("children is not null"),
        upper.where("root").select("tree", "n", empty.alias("proof"), F.lit(None).cast("string").alias("subroot")), count, scratch,
    )
    starts = scratch.put(over.select(F.col("item.own").alias("tree"), F.col("item.size").alias("n"), "proof", F.col("item.subroot").alias("subroot")))
    proven = prove(placed.select("tree", "idx", "item"), links.where("children is not null"), starts, largest, scratch)
    return proven.select("item.*", "proof", "subroot"), root


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = ["doc_id", "source", "lang", "n_chars"]
    leaf, harmed = leaf_digest(*kept, "text"), leaf_digest(*kept, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("source", "doc_id", leaf.alias("leaf"), F.when(hit & (F.instr("text", "\n") > 0), harmed).alias("harmed"))
    with Scratch(spark) as scratch:
        proven, root = manifest(leaves, scratch)
        folded = fold(F.coalesce("harmed", "leaf"), F.col("proof"))
        out = proven.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), siblings_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
        return scratch.keep(out).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS tree, text, doc_id::VARCHAR AS i,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents
), marked AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, replace(text, chr(10), '') AS less,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(i, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS crc
  FROM rows
), leaves AS (
  SELECT doc_id, tree, leaf, CASE WHEN i IS NOT NULL AND crc % 2 = 0 THEN sha256(head || coalesce(strlen(less) || ':' || less, '-')) ELSE leaf END AS harmed,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS rid
  FROM marked
), low AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, idx // 3
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, idx, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, idx // 3
), runs AS (
  SELECT tree, level, idx // 3 AS p, list(digest ORDER BY idx) AS k FROM low WHERE n > 1 GROUP BY ALL
), tops AS (
  SELECT level, idx // 3 AS p, list(digest ORDER BY idx) AS k FROM high WHERE n > 1 GROUP BY ALL
), up AS (
  SELECT rid, tree, 0 AS level, idx, harmed AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT rid, up.tree, up.level + 1, idx // 3,
         sha256(array_to_string(k[: idx % 3], '') || folded || array_to_string(k[idx % 3 + 2 :], '')),
         proof || array_to_string(k[: idx % 3], '') || array_to_string(k[idx % 3 + 2 :], '')
  FROM up JOIN runs ON runs.tree = up.tree AND runs.level = up.level AND runs.p = idx // 3
), over AS (
  SELECT rid, 0 AS level, s.idx, folded, proof
  FROM (SELECT rid, any_value(tree) AS tree, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM up GROUP BY rid) JOIN subroots s USING (tree)
  UNION ALL
  SELECT rid, over.level + 1, idx // 3,
         sha256(array_to_string(k[: idx % 3], '') || folded || array_to_string(k[idx % 3 + 2 :], '')),
         proof || array_to_string(k[: idx % 3], '') || array_to_string(k[idx % 3 + 2 :], '')
  FROM over JOIN tops ON tops.level = over.level AND tops.p = idx // 3
), ends AS (
  SELECT rid, arg_max(folded, level) AS folded_root, arg_max(proof, level) AS proof FROM over GROUP BY rid
), root AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN ends USING (rid) JOIN subroots USING (tree) CROSS JOIN root
"""
