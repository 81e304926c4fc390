"""Prefix tries of conversations: how much work a cache of shared prefixes would save.

A conversation's turns are read in order once, in a stream that keeps only the digest of the prefix so far, so a conversation
of any length needs no more memory than one turn. Each prefix is a row under its digest. Partitions combine the rows they have
into a node table (a partial trie), and node tables of FAN partitions at a time are merged by key until one is left: members are
counted, the smallest is kept. Conversations that end at a node form its end list; lists are runs of sorted ids that tasks
write from ranges and that are hashed in order as a stream.

The rollup is by chains. The nodes whose smallest member is the same conversation are the last nodes of its path, as a child's
members are among its parent's. Sums are made inside each chain from its end upwards, and the sum of a chain is added to all
nodes of its conversation's path above it, so there is one aggregation for any depth of the trie.

Defined cases: null turn comes first; null role and text are empty; equal turn numbers are ordered by the digest of role and
text; repeated rows are turns of their own; rows with null conv_id take no part; an empty table has no node, not even a root;
a conversation without turns ends at the root; extra columns are ignored; texts are hashed where they are read, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Node tables merged into one at a time; ids of a run of an end list.
FAN, RUN_IDS = 64, 4096
ROOT = hashlib.blake2b(digest_size=16).digest()
BROADCAST_ROWS = 200_000

PREFIXES = "conv_id long, depth long, key binary, parent binary, bytes long, last boolean"


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return slim.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Conversations whose first turns are those of another: conv_id, part, pos, digest, bytes, in order of part and pos.

    ``base`` and ``taken`` are of conv_id: whose first turns, and how many, stand in for as many of its own. Part 0 is a row of each conversation itself."""
    convs = turns.where("pos = 0").select("conv_id", base.alias("base"), taken.cast("long").alias("taken"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), none("binary", "digest"), none("long", "bytes"))
    lent = convs.join(turns.select(F.col("conv_id").alias("base"), "pos", "digest", "bytes"), "base").where("pos < taken")
    own = turns.where(F.col("pos") >= taken)
    return heads.unionByName(lent.select("conv_id", F.lit(1).alias("part"), "pos", "digest", "bytes")).unionByName(own.select("conv_id", F.lit(2).alias("part"), "pos", "digest", "bytes"))


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each prefix of each conversation; rows come sorted. A row is held until the next one shows whether it is its conversation's last."""
    names = [f.split()[0] for f in PREFIXES.split(", ")]
    held, conv, depth, key = None, None, 0, ROOT
    for batch in batches:
        out = []
        for c, part, digest, size in zip(batch["conv_id"].tolist(), batch["part"].tolist(), batch["digest"], batch["bytes"].tolist()):
            if held is not None:
                out.append((*held, c != conv))
            if part == 0:
                conv, depth, key = c, 0, ROOT
                held = (c, 0, ROOT, None, 0)
            else:
                parent, depth = key, depth + 1
                key = hashlib.blake2b(parent + digest, digest_size=16).digest()
                held = (c, depth, key, parent, int(size))
        if out:
            yield pd.DataFrame(out, columns=names)
    if held is not None:
        yield pd.DataFrame([(*held, True)], columns=names)


def prefixes(conversations: DataFrame) -> DataFrame:
    """PREFIXES of conversations(conv_id, part, pos, digest, bytes)."""
    ordered = conversations.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ordered.select("conv_id", "part", "digest", "bytes").mapInPandas(_prefixes, PREFIXES)


def merge_tries(rows: DataFrame) -> DataFrame:
    """Node tables of partitions, merged FAN at a time by key: key, parent, depth, bytes, n_convs, conv_id (smallest member)."""
    parts = rows.rdd.getNumPartitions()
    of = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    tries = rows.select("key", "parent", "depth", "bytes", F.lit(1).cast("long").alias("n_convs"), "conv_id", F.floor(F.spark_partition_id() / FAN).alias("part"))
    while parts > FAN:
        tries = tries.groupBy("key", "part").agg(*of).withColumn("part", F.floor(F.col("part") / FAN))
        parts = -(-parts // FAN)
    return tries.groupBy("key").agg(*of)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of sorted (key, conv_id) rows: key, first id, the ids joined."""
    held, ids = None, []
    for batch in batches:
        out = []
        for key, conv in zip(batch["key"], batch["conv_id"].tolist()):
            if held is not None and (key != held or len(ids) == RUN_IDS):
                out.append((held, ids[0], ",".join(map(str, ids))))
                ids = []
            held = key
            ids.append(conv)
        if out:
            yield pd.DataFrame(out, columns=["key", "first_id", "ids"])
    if ids:
        yield pd.DataFrame([(held, ids[0], ",".join(map(str, ids)))], columns=["key", "first_id", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sha256 of the runs of each key, which come in order, joined."""
    held, state = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch["key"], batch["ids"]):
            if key == held:
                state.update(b"," + ids.encode())
                continue
            if held is not None:
                out.append((held, state.hexdigest()))
            held, state = key, hashlib.sha256(ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if held is not None:
        yield pd.DataFrame([(held, state.hexdigest())], columns=["key", "ends_sha256"])


def end_lists(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, first_id, ids): the conversations that end at each node, as sorted runs of at most RUN_IDS ids."""
    ends = scratch.put(rows.where("last").select("key", "conv_id"))
    return ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(_runs, "key binary, first_id long, ids string")


def end_digests(runs: DataFrame) -> DataFrame:
    return runs.repartition("key").sortWithinPartitions("key", "first_id").select("key", "ids").mapInPandas(_hashed, "key binary, ends_sha256 string")


def trie(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of PREFIXES rows with sums over their subtrees: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes."""
    nodes = scratch.put(merge_tries(rows))
    chain = Window.partitionBy("conv_id")
    upward = chain.orderBy(F.col("depth").desc())
    placed = nodes.select("*", F.max("depth").over(chain).alias("end"), F.min("depth").over(chain).alias("begin"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(upward).alias("saved"))
    placed = scratch.put(placed)
    heads = placed.where("depth = begin").select("key", "conv_id", "parent", "begin", "end", "saved")
    attached = scratch.put(heads.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("chains")))
    # a chain ends in a leaf if no other chain is attached to its last node
    ends = placed.where("depth = end").select("key", "conv_id").join(attached, "key", "left").select("conv_id", F.when(F.col("chains").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    chains = scratch.put(heads.join(ends, "conv_id").select("conv_id", "parent", "begin", "saved", "leaf"))
    below = rows.join(chains, "conv_id").where(F.col("depth") < F.col("begin")).groupBy("key").agg(F.sum(chains["saved"]).alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    over = _over(placed, chains, attached, scratch)
    out = placed.join(attached, "key", "left").join(below, "key", "left").join(ends.select(F.col("conv_id"), "leaf"), "conv_id").join(over, "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "key",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("begin"), F.col("conv_id")).otherwise(F.col("over")).alias("parent_conv_id"),
        "n_convs",
        (zero("chains") + (F.col("depth") < F.col("end")).cast("long")).alias("n_children"),
        (zero("more_leaves") + F.col("leaf")).alias("n_leaves"),
        (zero("more_saved") + F.col("saved")).cast("long").alias("saved_bytes"),
    )


def _over(placed: DataFrame, chains: DataFrame, attached: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, over): the smallest member of the node that a chain is attached to. Nodes with over 1,000 chains are few and are broadcast."""
    named = placed.select(F.col("key").alias("parent"), F.col("conv_id").alias("over"))
    many = scratch.put(attached.where("chains > 1000").select(F.col("key").alias("parent")).join(named, "parent"))
    if many.count() > BROADCAST_ROWS:
        return chains.select("conv_id", "parent").join(named, "parent").select("conv_id", "over")
    there = chains.select("conv_id", "parent").where("parent is not null")
    wide = there.join(F.broadcast(many), "parent").select("conv_id", "over")
    rest = there.join(F.broadcast(many.select("parent")), "parent", "left_anti")
    return wide.unionByName(rest.join(named, "parent").select("conv_id", "over"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    with Scratch(spark) as scratch:
        turns = scratch.put(turn_rows(conversations))
        c = F.col("conv_id")
        rows = scratch.put(prefixes(rebuilt(turns, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9)))
        ends = end_digests(end_lists(rows, scratch))
        nodes = trie(rows, scratch).join(ends, "key", "left")
        none = hashlib.sha256(b"").hexdigest()
        return scratch.keep(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


OP13_SQL = """
WITH turns AS (
  SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS digest, strlen(text) AS bytes, turn
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM turns
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)
), built AS (
  SELECT c, 1 AS part, pos, digest, bytes FROM convs JOIN placed ON conv_id = base WHERE pos < h
  UNION ALL SELECT c, 2, pos, digest, bytes FROM convs JOIN placed ON conv_id = c WHERE pos >= h
), paths AS (
  SELECT c, row_number() OVER w AS depth, md5(string_agg(digest, '') OVER w) AS key, bytes FROM built WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM convs
), steps AS (
  SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS last FROM paths
), nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs, min(c) AS conv_id,
         sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM steps GROUP BY key
), kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1
), sums AS (
  SELECT up.key, sum((n.n_convs - 1) * n.bytes) AS saved, sum(CASE WHEN n.key NOT IN (SELECT key FROM kids) THEN 1 ELSE 0 END) AS leaves
  FROM nodes n JOIN steps up ON up.c = n.conv_id AND up.depth <= n.depth GROUP BY up.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN nodes p ON p.key = n.parent
"""
