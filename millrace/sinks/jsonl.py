"""Writers that never replace anything unseen."""

import csv
import io
import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.spans import with_parsed
from millrace.operators.checks import guarded
from millrace.sources.files import ROW_LEVEL_KEYS
from millrace.tables import scratch_path


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object a line, UTF-8. The path must not exist."""
    df.write.mode("errorifexists").json(path)


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Rows and the sum of their hashes, which doesn't depend on their order; a table whose order counts has a column that says it."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)), F.sum(h)).first()
    return r[0], str(r[1] or 0)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_locked(tables: Mapping[str, DataFrame], spark: SparkSession) -> list[str]:
    """Writes each table to its path. A path that holds the same rows is left alone; if one holds others, nothing is written."""
    todo = []
    for path, df in tables.items():
        if not _exists(spark, path):
            todo.append(path)
        elif table_digest(spark.read.schema(df.schema).json(path)) != table_digest(df):
            raise FileExistsError(f"{path} holds other rows")
    for path in todo:
        write_jsonl(tables[path], path)
    return todo


def confined(path: str, root: str) -> str:
    """The path, if it lies under the root once links on this machine are followed; row-level output may go nowhere else."""
    inside = lambda p, r: ".." not in p.split("/") and p.startswith(r.rstrip("/") + "/")
    real = (os.path.realpath(path), os.path.realpath(root)) if "://" not in path else (path, root)
    if not inside(path, root) or not inside(*real):
        raise ValueError(f"{path} isn't under {root}")
    return path


def write_at_least(df: DataFrame, path: str, least: int) -> int:
    """Writes the rows if there are enough of them, else raises and writes nothing."""
    n = df.count()
    if n < least:
        raise ValueError(f"{n} rows, fewer than {least}")
    write_jsonl(df, path)
    return n


def prediction_payload(df: DataFrame, eval_sha256: str, *more: str) -> DataFrame:
    """Columns of a prediction record; a null output or group raises."""
    ok = F.col("raw_output").isNotNull() & (F.coalesce("group_sha256", F.lit("")) != "")
    return df.select(F.col("id").cast("string").alias("id"), "group_sha256", F.lit(eval_sha256).alias("eval_file_sha256"), guarded(ok, F.col("raw_output"), "prediction or group is missing").alias("raw_output"), *more)


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file in whatever store the path names. A file that exists already raises."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_manifest(one_row: DataFrame, path: str) -> None:
    """A table of one row as a JSON file with indent 2, which must not exist yet."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a manifest has one row")
    _create(one_row.sparkSession, path, json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2))


def write_rating_template(cases: DataFrame, path: str) -> None:
    """One CSV file with a header and a byte order mark, for people to fill in with a spreadsheet; a study's few cases."""
    text = io.StringIO()
    lines = csv.writer(text, lineterminator="\r\n")
    lines.writerow(cases.columns)
    lines.writerows(["" if v is None else v for v in r] for r in cases.toLocalIterator())
    _create(cases.sparkSession, path, "\ufeff" + text.getvalue())


def public_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are private to a run: those whose names begin with _."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def aggregates_only(report: DataFrame) -> DataFrame:
    """The report, if none of its columns belongs to single rows; else it raises, at any depth of its schema."""
    names: list[str] = []

    def walk(kind) -> None:
        for field in getattr(kind, "fields", ()):
            names.append(field.name)
            walk(field.dataType)
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                walk(getattr(kind, inner))

    walk(report.schema)
    private = sorted(set(names) & set(ROW_LEVEL_KEYS))
    if private:
        raise ValueError(f"row-level columns: {', '.join(private)}")
    return report


def parsed_payload(df: DataFrame, eval_sha256: str, raw: str = "raw_output", utterance: str = "utt") -> DataFrame:
    """``prediction_payload`` with the parsed prediction and its validity."""
    p = with_parsed(df, raw, utterance, "_p")
    validity = F.struct(*[F.col(f"_p.{c}").alias(c) for c in ("json_valid", "schema_valid", "copy_valid", "error")])
    return prediction_payload(p.withColumn("prediction", F.col("_p.slots")).withColumn("validity", validity), eval_sha256, "prediction", "validity")
