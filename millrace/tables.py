"""Intermediate tables and row numbers that no single task has to make."""

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many rows a window without a bound may hold in one task.
ONE_TASK = 100_000
#: Rows of a range, about, and rows of counts broadcast at most.
RANGE_ROWS, BROADCAST_ROWS = 100_000, 100_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, or new ones of the same name, that are made once a row.

    Spark puts an expression in the place of its name wherever that is used: in filters, in both sides of a test and within lambdas, where
    it is made again for each element. What comes out of an explode stays a value."""
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    return df.select(*kept, made).select(*kept, "_once.*")


def written(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: made once, whatever reads them, and safe from lost executors.

    The table stays as long as the folder does, as results may read it. ``group_bytes`` bounds its row groups."""
    path = scratch_path(df.sparkSession, "table")
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_of(names: Sequence[str]) -> Column:
    """A key for joins by group in which nulls equal each other."""
    return F.struct(*names) if names else F.lit(0)


def numbered(rows: DataFrame, within: Sequence[str], order: Sequence[str], name: str, bound: int | None = None) -> DataFrame:
    """Numbers the rows of each group from 1 in an order that tells all rows apart.

    A ``bound`` on the rows of a group that one task can hold allows a plain window. Otherwise rows are written and cut into ranges
    of the order, numbered in each, and the sizes of the ranges before are added; a group of any size is spread over tasks."""
    if bound is not None and bound <= ONE_TASK:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    once = written(rows)
    ranged = written(once.repartitionByRange(max(1, -(-once.count() // RANGE_ROWS)), *within, *order).withColumn("_run", F.spark_partition_id()).withColumn("_group", group_of(within)))
    before = Window.partitionBy("_group").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(ranged.groupBy("_group", "_run").agg(F.count(F.lit(1)).alias("_n")).select("_group", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy("_group", "_run").orderBy(*order))
    placed = ranged.withColumn("_own", own).join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, ["_group", "_run"])
    return placed.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_group", "_run", "_before", "_own")
