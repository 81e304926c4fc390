"""Members of tar archives as rows."""

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.checks import count_mismatch, guarded


def _members(batches: Iterator[pd.DataFrame], suffix: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                found = [m for m in tar.getmembers() if m.isfile() and m.name.endswith(suffix)]
                if len(found) != 1:
                    raise ValueError(f"{path}: {len(found)} members end with {suffix}, not one")
                lines = enumerate(io.TextIOWrapper(tar.extractfile(found[0]), "utf-8"))
                while part := [x for _, x in zip(range(10_000), lines)]:
                    yield pd.DataFrame([(path, found[0].name, n + 1, line.rstrip("\n")) for n, line in part], columns=["path", "member", "line", "value"])


def member_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, member, line, value): the lines of the one member of each archive that ends with ``suffix``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lambda b: _members(b, suffix), "path string, member string, line long, value string")


def member_bytes(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, content): the one member of each archive that ends with ``suffix``, such as its licence."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    found = [m for m in tar.getmembers() if m.isfile() and m.name.endswith(suffix)]
                    if len(found) != 1:
                        raise ValueError(f"{name}: {len(found)} members end with {suffix}, not one")
                    yield pd.DataFrame([(name, tar.extractfile(found[0]).read())], columns=["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, content binary")


def read(spark: SparkSession, path: str, schema: T.StructType, suffix: str = "zh-CN.jsonl", partitions: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of a plain file or an archive's member, of the given partitions only. A line that isn't valid raises."""
    if path.endswith((".tar", ".tar.gz", ".tgz")):
        lines = member_lines(spark, path, suffix).where("trim(value) <> ''")
        rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        from .jsonl import scan_strict

        rows = scan_strict(spark, path, schema)
    return rows.where(F.col("partition").isin(*partitions)) if partitions else rows


def read_with_licence(spark: SparkSession, path: str, schema: T.StructType, suffix: str = "zh-CN.jsonl", licence: str = "LICENSE") -> tuple[DataFrame, bytes]:
    """(rows, bytes of the licence) of one archive that has exactly one member of either kind."""
    found = member_bytes(spark, path, licence).collect()  # one archive, one small file
    if len(found) != 1:
        raise ValueError(f"{path} isn't one archive")
    return read(spark, path, schema, suffix), bytes(found[0]["content"])


def load_partitions(rows: DataFrame, partitions: tuple[str, ...], locale: str) -> DataFrame:
    """id, partition, scenario, utt and intent of rows; a foreign partition or locale, or a blank field, raises when the row is read."""
    fields = ("id", "scenario", "utt", "intent")
    whole = F.forall(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields]), lambda x: x != "")
    ok = F.col("partition").isin(*partitions) & (F.col("locale") == locale) & whole
    return rows.select(guarded(ok, F.col("id"), "a row of another partition or locale, or a blank field").alias("id"), "partition", *fields[1:])


def partition_violations(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(what, n): partitions of another size than expected, ids that repeat within one, ids that several share."""
    sizes = count_mismatch(rows, "partition", expected).select(F.concat(F.lit("size of "), "partition").alias("what"), "n")
    by = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("p"))
    ids = by.agg(F.count_if((F.col("n") > 1) & (F.col("p") == 1)).alias("repeated ids"), F.count_if(F.col("p") > 1).alias("shared ids"))
    rows_ = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ids.columns]))
    return sizes.unionByName(ids.select(rows_.alias("r")).select("r.*").where("n > 0"))
