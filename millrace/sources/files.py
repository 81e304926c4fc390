"""Listings and fingerprints of files, and the rules for a release tree."""

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.checks import guarded

#: What a public tree must not hold.
BLOCKED_PREFIXES = (".venv/", "_tmp/", "cache/", "models/", "outputs/", "data/raw/", "data/massive-zh/", "data/private/", "data/sft.licensed.", "data/dpo.licensed.", "data/dpo.eval.", ".env.")
BLOCKED_SUFFIXES = (".safetensors", ".gguf", ".joblib", ".onnx", ".pt", ".ckpt")
BLOCKED_REPORTS = ("reports/oasst2_blind_generation_eval", "reports/oasst2_blind_generation_key", "reports/oasst2_blind_generation_ratings")
ROW_LEVEL_KEYS = ("id", "ids", "source_id", "source_ids", "group_sha256", "utt", "utterance", "raw_output", "prediction", "correct_by_id", "per_row", "rows")
MOST_BYTES = 1024 * 1024


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative, length, path) of all files under a root, hidden and empty ones too; contents aren't read.

    Names and sizes are what a file system tells the driver anyway; a release tree has some thousands of them."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    found, rows = base.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(base, True), []
    while found.hasNext():
        f = found.next()
        path = f.getPath().toUri().getPath()
        rows.append((path.split(base.toUri().getPath().rstrip("/") + "/", 1)[1], f.getLen(), path))
    return spark.createDataFrame(rows, "relative string, length long, path string")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))  # files under 2 GB; locks.file_sha256 for others


def directory_fingerprint(spark: SparkSession, path: str, scope: str, required: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """One row: map of 'scope/name' to digest for the files right in a folder. A required name that is absent raises, and if
    ``exact`` one that isn't required."""
    files = fingerprint(spark, path).select(F.concat(F.lit(scope + "/"), F.substring_index("path", "/", -1)).alias("name"), "sha256")
    one = files.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "sha256")))).alias("digests"))
    need = F.array(*[F.lit(f"{scope}/{n}") for n in required]) if required else F.expr("cast(array() as array<string>)")
    ok = F.forall(need, lambda n: F.map_contains_key("digests", n)) & (F.lit(not exact) | (F.size("digests") == len(required)))
    return one.select(guarded(ok, F.col("digests"), "a required file is missing").alias("digests"))


def report_violations(spark: SparkSession, path: str) -> DataFrame:
    """(path, violation) of JSON reports that don't parse or hold keys of single rows, at any depth.

    A report is parsed as a variant; a key shows in the schema of the variant, whatever nests it."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    shape = F.schema_of_variant("v")
    found = F.array_sort(F.array_compact(F.array(*[F.when(shape.rlike(rf"[<\s`]{k}`?: "), F.lit(k)) for k in ROW_LEVEL_KEYS])))
    what = F.when(F.col("v").isNull(), "invalid JSON report").when(F.size(found) > 0, F.concat(F.lit("row-level keys: "), F.array_join(found, ", ")))
    return whole.select("path", what.alias("violation")).where("violation is not null")


def release_tree_check(files: DataFrame) -> DataFrame:
    """(relative, violation) of a listing(relative, length)."""
    name = F.col("relative")
    blocked = F.lit(False)
    for p in BLOCKED_PREFIXES:
        blocked = blocked | name.startswith(p)
    for s in BLOCKED_SUFFIXES:
        blocked = blocked | F.lower(name).endswith(s)
    for p in BLOCKED_REPORTS:
        blocked = blocked | name.startswith(p)
    blocked = blocked | (name == ".env") | (name.startswith("reports/") & name.endswith(".jsonl"))
    found = F.array_compact(F.array(F.when(blocked, "forbidden path"), F.when(F.col("length") > MOST_BYTES, "file over 1 MiB")))
    return files.select("relative", F.explode(found).alias("violation"))


def release_tree_violations(spark: SparkSession, root: str) -> DataFrame:
    """(relative, violation) of a whole tree: paths, sizes, and the keys of its JSON reports."""
    files = listing(spark, root)
    reports = files.where("relative like 'reports/%.json'").select("relative", F.substring_index("relative", "/", -1).alias("_n"))
    found = report_violations(spark, f"{root.rstrip('/')}/reports/*.json") if reports.take(1) else None
    out = release_tree_check(files)
    return out if found is None else out.unionByName(found.select(F.concat(F.lit("reports/"), F.substring_index("path", "/", -1)).alias("relative"), "violation"))


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """(relative) of the files of a working copy that git tracks or would add."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=True).stdout
    return spark.createDataFrame([(x,) for x in sorted(set(out.decode("utf-8").split("\0")) - {""})], "relative string")
