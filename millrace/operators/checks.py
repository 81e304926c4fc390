"""Constraint checks: each returns the violations, or their count, as a DataFrame.

``enforce`` turns a check into a guard that raises before anything is written.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A table breaks a rule that the data it came with states."""


def enforce(violations: DataFrame, what: str) -> None:
    """Raises if there is a violation. Only a few rows of it reach the driver."""
    some = violations.limit(3).collect()
    if some:
        raise ConstraintError(f"{what}: {', '.join(str(r.asDict()) for r in some)}")


def guarded(ok, column, what: str):
    """The column, where the test holds; elsewhere reading it raises."""
    return F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit(what))).otherwise(column)


def dup_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of the left that the right lacks (missing) and the other way round (extra)."""
    a = left.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(True))
    both = a.join(b, "k", "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("n_missing"), F.count_if(F.col("l").isNull()).alias("n_extra"))


def split_leakage(df: DataFrame, key: str, split: str) -> DataFrame:
    """How many keys stand in both of two splits, for each pair of splits that shares one.

    One aggregation by key finds the splits of each; the pairs come out of a key's own list, never from a join.
    """
    splits = df.select(F.unhex(F.sha2(F.col(key).cast("string"), 256)).alias("_h"), split).groupBy("_h").agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = splits.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n_keys"))


def reserved_overlap(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that more than one reserved set holds, with the number of sets."""
    tagged = reduce(DataFrame.unionByName, [df.select(key).distinct().withColumn("tag", F.lit(tag)) for tag, df in sets.items()])
    return tagged.groupBy(key).agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")


def not_subset(required: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Values of the first that the second lacks."""
    return required.select(key).distinct().join(allowed.select(key).distinct(), key, "left_anti")


def stale_hash(df: DataFrame, key, stored: str) -> DataFrame:
    """Rows whose stored hash isn't the hash of their key."""
    return df.where(~F.sha2(key, 256).eqNullSafe(F.col(stored)))


def reserved_resolution(hashes: DataFrame, texts: DataFrame, key: str, hash_column: str = "group_sha256") -> DataFrame:
    """One row: reserved hashes that some text's key has (resolved) and that none has (unresolved). Must be total."""
    known = texts.select(F.sha2(F.col(key), 256).alias(hash_column)).distinct().withColumn("found", F.lit(True))
    return hashes.select(hash_column).distinct().join(known, hash_column, "left").agg(
        F.count_if(F.col("found").isNotNull()).alias("n_resolved"), F.count_if(F.col("found").isNull()).alias("n_unresolved")
    )


def count_mismatch(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Values whose number of rows isn't the one expected; absent values count 0."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected long")
    have = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, column, "full_outer").select(column, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("expected <> n")


def hex_digest(column: str, either_case: bool = False):
    """Whether the column is 64 hex digits."""
    return F.coalesce(F.col(column).rlike("^[0-9a-fA-F]{64}$" if either_case else "^[0-9a-f]{64}$"), F.lit(False))


def order_mismatch(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """Positions at which two ordered tables differ or one has no row."""
    a, b = left.select(position, F.col(key).alias("left_key")), right.select(position, F.col(key).alias("right_key"))
    return a.join(b, position, "full_outer").where(~F.col("left_key").eqNullSafe(F.col("right_key")))
