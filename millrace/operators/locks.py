"""Locks: what must hold before held-out data may be opened, and what must not change meanwhile.

Facts are plain dictionaries (hashes, counts, settings). They are small, and they are compared on the driver, before any
read is planned.
"""

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import ConstraintError, dup_keys, enforce


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def file_sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file of any size, streamed by the file system's reader."""
    fs, place = _file(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """A file that holds one JSON object; anything else raises."""
    rows = spark.read.text(path, wholetext=True).collect()
    value = json.loads(rows[0]["value"]) if len(rows) == 1 else None
    if not isinstance(value, dict):
        raise ConstraintError(f"{path} isn't one JSON object")
    return value


def assets(spark: SparkSession, paths: Iterable[str]) -> dict[str, str]:
    return {p: file_sha256(spark, p) for p in paths}


def differences(expected: Mapping[str, object], found: Mapping[str, object], names: Iterable[str] | None = None) -> list[str]:
    """Names whose facts differ or that one side lacks."""
    missing = object()
    return sorted(n for n in (names if names is not None else {*expected, *found}) if expected.get(n, missing) != found.get(n, missing))


@contextmanager
def frozen(spark: SparkSession, paths: Iterable[str]) -> Iterator[dict[str, str]]:
    """Raises at the end if a file isn't what it was at the beginning."""
    before = assets(spark, paths)
    yield before
    changed = differences(before, assets(spark, before))
    if changed:
        raise ConstraintError(f"changed meanwhile: {', '.join(changed)}")


def preflight(spark: SparkSession, path: str, role: str, expected: Mapping[str, object], roles: tuple[str, ...] = ("train", "dev", "confirmation", "test")) -> dict:
    """The manifest beside a split's file, after these have been checked in order, without a row of the file being read: the file
    is named after its role, the manifest's facts are the expected ones (format, partition, source hash), and it names the file's hash."""
    folder, _, name = path.rpartition("/")
    if role not in roles or name != f"{role}.jsonl":
        raise ConstraintError(f"{name} isn't the file of {role}")
    manifest = read_json(spark, f"{folder}/manifest.json")
    wrong = differences(expected, manifest, expected)
    if wrong:
        raise ConstraintError(f"the manifest differs in {', '.join(wrong)}")
    entry = manifest.get("splits", {}).get(role)
    if not isinstance(entry, dict) or entry.get("jsonl_sha256") != file_sha256(spark, path):
        raise ConstraintError(f"{name} isn't the file that the manifest names")
    return manifest


def compose_lock(report: Mapping[str, object], expected: Mapping[str, object], decision: Mapping[str, bool], **facts: object) -> dict:
    """A lock for one test from a development report: the report must state the expected facts and a decision whose checks all
    hold and are the ones computed from its metrics."""
    wrong = differences(expected, report, expected)
    if wrong:
        raise ConstraintError(f"the report differs in {', '.join(wrong)}")
    if report.get("checks") != dict(decision) or not decision or not all(decision.values()):
        raise ConstraintError("the candidate hasn't passed its gate")
    return {"status": "selected_for_one_test", **expected, **facts}


def verify_lock(lock: Mapping[str, object], facts: Mapping[str, object], status: str = "selected_for_one_test") -> None:
    wanted = {"status": status, **facts}
    wrong = differences(wanted, lock, wanted)
    if wrong:
        raise ConstraintError(f"the lock differs in {', '.join(wrong)}")


def held_out(spark: SparkSession, lock_path: str, lock_sha256: str, facts: Callable[[], Mapping[str, object]], read: Callable[[], DataFrame]) -> DataFrame:
    """Held-out rows. ``read`` isn't called, so nothing is planned, before the lock is the one given and states the facts as they are."""
    if file_sha256(spark, lock_path) != lock_sha256:
        raise ConstraintError("another lock than the one selected")
    verify_lock(read_json(spark, lock_path), facts())
    return read()


# --- earlier studies ---------------------------------------------------------------------


def read_back_violations(old: DataFrame, source: DataFrame, key: str, row_id: str = "id") -> DataFrame:
    """(id, violation): rows of an earlier training set that the source lacks, whose key differs from the source's, or that repeat."""
    s = source.select(F.col(row_id).cast("string").alias("id"), F.sha2(key, 256).alias("_s"))
    o = old.select(F.col(row_id).cast("string").alias("id"), F.sha2(key, 256).alias("_o"))
    j = o.join(s, "id", "left")
    kind = F.when(F.col("_s").isNull(), "absent").when(F.col("_s") != F.col("_o"), "other_key")
    odd = j.select("id", kind.alias("violation")).where("violation is not null")
    return odd.unionByName(dup_keys(o, "id").select("id", F.lit("duplicate_id").alias("violation")))


def prior_assets(official: DataFrame, assets_by_name: Mapping[str, DataFrame], expected: Mapping[str, int], key: str) -> tuple[DataFrame, DataFrame]:
    """(distinct keys of all earlier sets, counts by set), after each set's ids, keys and number of rows have been checked."""
    for name, old in assets_by_name.items():
        enforce(read_back_violations(old, official, key), f"{name} isn't from the source")
    named = [t.select(F.lit(n).alias("asset"), key) for n, t in assets_by_name.items()]
    every = named[0]
    for t in named[1:]:
        every = every.unionByName(t)
    counts = every.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(key, 256)).alias("n_groups"))
    found = {r["asset"]: r["n"] for r in counts.collect()}  # a row for each earlier set
    if found != dict(expected):
        raise ConstraintError(f"{found} rows, {dict(expected)} expected")
    return every.select(key).distinct(), counts
