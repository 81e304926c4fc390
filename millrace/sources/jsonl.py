"""JSON lines and JSON objects with declared schemas. Nothing is inferred."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.checks import ConstraintError, guarded
from millrace.tables import BROADCAST_ROWS, written


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows, with the file of each and, for a line that isn't valid, the line itself in ``error``. Blank lines are skipped."""
    wide = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").json(path).select("*", F.col("_metadata.file_path").alias("file"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1, blank ones too, whatever ranges a file is read in.

    Lines are counted per range; a line's place in its range comes from the ids that Spark gives in the order of reading, and the
    counts of the ranges before are added up. Texts are not shuffled."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(*place, "value", F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranges = written(ranges.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    joined = lines.join(F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges, ["file", "_block"])
    return joined.select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def scan_located(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows with the file and line number of each and, for a line that isn't valid, the line itself in ``error``. Blank lines are skipped."""
    wide = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    return numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$")).select("file", "line", parsed.alias("_r")).select("_r.*", "file", "line")


def require_valid(located: DataFrame) -> None:
    """Raises if a scanned line isn't valid, and names the first ones by file and line."""
    bad = located.where("error is not null").select("file", "line").orderBy("file", "line").limit(5).collect()
    if bad:
        raise ConstraintError("invalid lines: " + ", ".join(f"{r['file']}:{r['line']}" for r in bad))


def scan_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows; a line that isn't valid raises when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with blank lines, for readers to whom such a line is an error."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*$"))
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def with_order(df: DataFrame, *by: str) -> DataFrame:
    """Adds ``ord``, the row's place in the order of the columns, for joins by position. Only for tables bounded by a study's size."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*by)).cast("long"))


def load_object(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON object, as one row. An array, several objects or anything else raises."""
    whole = spark.read.text(path, wholetext=True).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))  # one row, of an empty file too
    # between brackets, as text behind a first value would be passed over
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    kind = F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant"))
    ok = (F.col("n") == 1) & F.coalesce(kind.startswith("OBJECT<"), F.lit(False)) & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return whole.select(F.from_json(guarded(ok, F.col("value"), "not one JSON object"), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """id, group_sha256, eval_file_sha256, raw_output and prediction of a prediction file, and error: a line that isn't a JSON object.

    Numbers, arrays and other values that aren't strings are null; an id may be a number too. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    v = lines.select("value", listed.alias("l")).select("value", F.when(F.try_variant_get("l", "$[1]", "variant").isNull(), F.try_variant_get("l", "$[0]", "variant")).alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False))

    def text(name: str, also: tuple[str, ...] = ()) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        return F.when(is_object & kind.isin("STRING", *also), F.try_variant_get("v", f"$.{name}", "string")).alias(name)

    return v.select(text("id", ("BIGINT",)), *[text(c) for c in ("group_sha256", "eval_file_sha256", "raw_output", "prediction")], F.when(~is_object, F.col("value")).alias("error"))


def json_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """JSON lines as a table of the columns wanted; the others aren't parsed."""
    rows = scan_strict(spark, path, schema)
    return rows.select(*columns) if columns else rows


def pinned(spark: SparkSession, root: str, revision: str, schema: T.StructType) -> DataFrame:
    """The files of one revision of a data set, which lies in a folder of the revision's name; the name must be a commit hash."""
    if not re.fullmatch(r"[0-9a-f]{40}", revision):
        raise ValueError(f"{revision!r} isn't a commit hash")
    return scan_strict(spark, f"{root.rstrip('/')}/{revision}", schema)


def named_path(argument: str) -> tuple[str, str]:
    """NAME=path of a command line."""
    name, separator, path = argument.partition("=")
    if not separator or not path or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]{0,39}", name):
        raise ValueError("NAME=path is wanted, with a name of letters, digits, _ and -")
    return name, path
