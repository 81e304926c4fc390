"""Extension: scores of model outputs as they arrive.

Prediction files are read as a stream, parsed strictly and joined with the static gold table.

``running_scores`` adds up whatever arrives, in complete mode. ``score_changes`` counts each id once: the state of an id holds the
counts of its newest prediction, and a row leaves only if they change, as the difference. ``keep_changes`` writes the sum of
a batch's differences under the number of the batch, so a batch that is run again after a failure replaces what it left
behind; ``kept_scores`` adds up the batches.
"""

from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import parse_outputs, with_parsed
from millrace.operators.metrics import entity_counts, f1_of, ratio

PREDICTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("raw_output", T.StringType())])
VERSIONED = T.StructType([*PREDICTION.fields, T.StructField("version", T.LongType())])
COUNTS = ("n", "n_exact", "tp", "fp", "fn")
_COUNTS = ", ".join(f"{c} long" for c in COUNTS)


def read_predictions(spark: SparkSession, path: str, files_per_trigger: int = 100, schema: T.StructType = PREDICTION) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_scores(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over all predictions so far. gold(id, utt, slots)."""
    p = predictions.join(gold, "id").withColumn("p", parse_outputs("raw_output", "utt")).withColumn("pred", F.col("p.slots"))
    t = entity_counts(p, "slots", "pred", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return _rated(t)


def _rated(totals: DataFrame) -> DataFrame:
    return totals.select("*", f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"), ratio("n_exact", "n").alias("exact_rate"))


def _change(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The state (version, digest, counts) moves to the newest row seen; what that changes in the counts goes out."""
    held = tuple(state.get) if state.exists else None
    newest = held
    for frame in frames:
        for version, digest, *counts in frame[["version", "digest", *COUNTS]].itertuples(index=False, name=None):
            row = (int(version), digest, *map(int, counts))
            if newest is None or row[:2] > newest[:2]:
                newest = row
    if newest != held:
        state.update(newest)
        before = held[2:] if held else (0,) * len(COUNTS)
        yield pd.DataFrame([(key[0], *(b - a for a, b in zip(before, newest[2:])))], columns=["id", *COUNTS])


def _counted(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, version, digest, counts) of each prediction whose id gold has."""
    lowest = F.lit(-(1 << 63)).cast("long")
    p = predictions.join(gold, "id").select("*", F.sha2(F.coalesce("raw_output", F.lit("")), 256).alias("digest"))
    p = with_parsed(p.withColumn("version", F.coalesce("version", lowest)), "raw_output", "utt").withColumn("pred", F.col("p.slots"))
    counted = entity_counts(p, "slots", "pred", "id", "version", "digest")
    return counted.select("id", "version", "digest", F.lit(1).cast("long").alias("n"), F.col("exact").cast("long").alias("n_exact"), "tp", "fp", "fn")


def score_changes(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, n, n_exact, tp, fp, fn): by how much each prediction changes the sums. predictions(id, raw_output, version), gold(id, utt, slots).

    The highest version of an id counts, the one with the larger digest of the output if several have it; a null version is the
    lowest. Repeated and late rows change nothing; ids that gold doesn't have are left out."""
    counted = _counted(predictions, gold)
    return counted.groupBy("id").applyInPandasWithState(_change, f"id string, {_COUNTS}", f"version long, digest string, {_COUNTS}", "update", "NoTimeout")


def keep_changes(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the sums of a batch's changes, one row in a folder of its number."""

    def keep(batch: DataFrame, number: int) -> None:
        sums = batch.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def kept_scores(spark: SparkSession, path: str) -> DataFrame:
    """One row over all batches kept."""
    return _rated(spark.read.schema(_COUNTS).parquet(path).agg(*[F.sum(c).alias(c) for c in COUNTS]))


def score_stream(predictions: DataFrame, gold: DataFrame, path: str, checkpoint: str):
    """Starts a query that scores all that is there and ends; the next one, with the same checkpoint, goes on where it ended."""
    changes = score_changes(predictions, gold).writeStream.outputMode("update").foreachBatch(keep_changes(path))
    return changes.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_batches(predictions: DataFrame, gold: DataFrame, path: str, checkpoint: str):
    """``score_stream`` for very many ids, without a Python state for each: of each batch the newest row of an id is kept under the batch's
    number, so a batch that is run again replaces itself; ``newest_scores`` compares the batches."""

    def keep(batch: DataFrame, number: int) -> None:
        _newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _counted(predictions, gold).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame) -> DataFrame:
    """Of each id the row with the highest version, then digest."""
    return rows.groupBy("id").agg(F.max(F.struct("version", "digest", *COUNTS)).alias("r")).select("id", "r.*")


def newest_scores(spark: SparkSession, path: str) -> DataFrame:
    """One row over all that ``score_batches`` has kept: each id counts once."""
    rows = spark.read.schema(f"id string, version long, digest string, {_COUNTS}").parquet(path)
    return _rated(_newest(rows).agg(*[F.sum(c).alias(c) for c in COUNTS]))


def first_by_group(predictions: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return predictions.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
