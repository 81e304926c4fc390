"""Fingerprints of ordered data."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_fingerprint(df: DataFrame, order: str, record: Column, group: str, block: int = 1000) -> DataFrame:
    """(group, n_rows, fingerprint): a digest of each group's records in order.

    Records are hashed, then the hashes of ``block`` positions, then those of the blocks; a task holds a block or the
    list of blocks, never a group. ``order`` is a whole number, unique in the group.
    """
    d = df.select(group, F.floor(F.col(order) / block).alias("_b"), F.struct(F.col(order).alias("o"), F.sha2(record, 256).alias("h")).alias("r"))
    blocks = d.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list("r"))["h"], "\n"), 256).alias("h"))
    return blocks.groupBy(group).agg(F.sum("_n").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("_b", "h")))["h"], "\n"), 256).alias("fingerprint"))


def ids_fingerprint(df: DataFrame, group: str, row_id: str) -> DataFrame:
    """sha256 of the compact JSON array of each group's ids in order; a group is one split of a study."""
    return df.groupBy(group).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(row_id))), 256).alias("fingerprint"))
