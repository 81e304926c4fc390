"""Phrase groups: collecting by key, conflicts, representatives, leakage control."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phrase_groups(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """(key, n_members, first_id): groups by key. Members aren't gathered; their count and smallest id stand for them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), F.min(row_id).alias("first_id"))


def conflict_groups(df: DataFrame, key: str, signature) -> DataFrame:
    """Groups whose rows have more than one signature, with rows and signatures."""
    return df.select(key, signature.alias("_s")).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_s").alias("n_signatures")).where("n_signatures > 1")


def slot_signature(slots):
    """Equal for equal multisets of slots."""
    return F.to_json(F.array_sort(F.transform(slots, lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value")))))


def id_order(column: str):
    """Sort key for ids: decimal ones first and by their number, then the others as text."""
    number = F.when(F.col(column).rlike("^[0-9]{1,18}$"), F.col(column).cast("long"))
    return F.struct(number.isNull().alias("text"), number.alias("number"), F.col(column).alias("id"))


def representative(df: DataFrame, key: str, row_id: str, *columns: str) -> DataFrame:
    """Of each group the row with the smallest id, numbers before text."""
    best = F.min_by(F.struct(row_id, *columns), id_order(row_id)).alias("_r")
    return df.groupBy(key).agg(best, F.count(F.lit(1)).alias("n_members")).select(key, "_r.*", "n_members")


def prior_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys of all tables."""
    return reduce(DataFrame.unionByName, [t.select(key) for t in tables]).distinct()


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the keys. Put this before any Python function: it doesn't move below a join by itself."""
    return df.join(keys.select(key), key, "left_anti")


def members(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """(key, rows): the rows of each group in order, as an array of structs. For groups that a study bounds; see ``phrase_groups``."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("rows"))


def leakage_free(df: DataFrame, prior: DataFrame, key: str, row_id: str, label: str) -> DataFrame:
    """Groups that no prior key names: id of the representative, hash, members, and whether labels conflict.

    Keys are hashed as they are read, so 32 bytes a row cross the shuffle and not the text."""
    digest = F.unhex(F.sha2(key, 256)).alias("_h")
    used = prior.select(digest).distinct()
    kept = df.where(F.col(key) != "").select(digest, row_id, label).join(used, "_h", "left_anti")
    return kept.groupBy("_h").agg(
        F.min(row_id).alias("id"), F.count(F.lit(1)).alias("n_members"), (F.count_distinct(label) > 1).alias("is_conflict")
    ).select("id", F.lower(F.hex("_h")).alias("group_sha256"), "n_members", "is_conflict")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the highest order."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
