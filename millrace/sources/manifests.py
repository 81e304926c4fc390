"""Manifests of earlier studies: reserved groups, locks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.checks import ConstraintError, guarded, hex_digest
from millrace.operators.locks import file_sha256, read_json

#: The layouts in which studies list their groups: rows of a split, digests of a split, digests alone.
NESTED = "splits map<string, struct<groups: array<struct<group_sha256: string>>, source_ids: array<string>>>"
BY_SPLIT = "splits map<string, struct<group_sha256: array<string>>>"
FLAT = "group_sha256 array<string>"
TEST_ONLY = "test_group_sha256 array<string>, test_jsonl_sha256 string"


def reserved_hashes(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(split, group_sha256) of a manifest; one that isn't 64 hex digits raises."""
    m = spark.read.schema(layout).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if layout == TEST_ONLY:
        h = m.select(F.lit("test").alias("split"), F.explode("test_group_sha256").alias("group_sha256"))
    elif layout == FLAT:
        h = m.select(F.lit(None).cast("string").alias("split"), F.explode("group_sha256").alias("group_sha256"))
    else:
        own = m.select(F.explode("splits").alias("split", "s"))
        column = "s.groups.group_sha256" if layout == NESTED else "s.group_sha256"
        h = own.select("split", F.explode(column).alias("group_sha256"))
    return h.select("split", guarded(hex_digest("group_sha256"), F.col("group_sha256"), "not a digest").alias("group_sha256"))


def reserved_test_hashes(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """(split, group_sha256) of a manifest of one test, after its file has been found to have the hash that the manifest states."""
    stated = read_json(spark, path).get("test_jsonl_sha256")
    if stated != file_sha256(spark, payload):
        raise ConstraintError(f"{payload} isn't the test that {path} names")
    return reserved_hashes(spark, path, TEST_ONLY)


def after_guard(guard: Callable[[], None], read: Callable[[], DataFrame]) -> DataFrame:
    """Held-out data: ``read`` isn't called, so nothing is planned or opened, before the guard has passed."""
    guard()
    return read()
