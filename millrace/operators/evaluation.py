"""Evaluation that fails closed: ids, groups, files and gold annotations are checked before anything is counted.

Each ``*_violations`` gives (id, violation) rows; the entries below it raise ``ConstraintError`` on the first ones.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spans import TARGET_TYPES

from . import metrics
from .checks import enforce


def _listed(df: DataFrame, key: str, tests: Mapping[str, Column]) -> DataFrame:
    """A row for each test that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
    return df.select(key, F.explode(found).alias("violation"))


def id_violations(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Ids that either side repeats or lacks."""
    return _listed(_sides(gold.select(key), predictions.select(key), key), "id", _ID_TESTS())


def alignment_violations(gold: DataFrame, predictions: DataFrame, eval_sha256: str, key: str = "id") -> DataFrame:
    """What keeps predictions(key, group_sha256, eval_file_sha256, raw_output) from belonging to gold(key, group_sha256), row by row and
    in any order. One aggregation a side, one join."""
    both = _sides(gold, predictions, key, eval_sha256)
    tests = _ID_TESTS() | {
        "foreign_group": (F.col("n_gold") > 0) & (F.col("n_pred") > 0) & ~(F.col("gold_groups").eqNullSafe(F.col("pred_groups"))),
        "foreign_file": F.col("n_foreign") > 0,
        "missing_output": F.col("n_blank") > 0,
    }
    return _listed(both, "id", tests)


def _ID_TESTS() -> dict[str, Column]:
    g, p = F.coalesce("n_gold", F.lit(0)), F.coalesce("n_pred", F.lit(0))
    return {"duplicate_gold": g > 1, "duplicate_prediction": p > 1, "missing_prediction": p == 0, "extra_prediction": g == 0}


def _sides(gold: DataFrame, predictions: DataFrame, key: str, eval_sha256: str | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    more_g, more_p = [], []
    if eval_sha256 is not None:
        ends = lambda c: F.struct(F.min(c).alias("low"), F.max(c).alias("high"))
        more_g = [ends("group_sha256").alias("gold_groups")]
        more_p = [ends("group_sha256").alias("pred_groups"), F.count_if(~F.col("eval_file_sha256").eqNullSafe(F.lit(eval_sha256))).alias("n_foreign"), F.count_if(F.col("raw_output").isNull()).alias("n_blank")]
    g = gold.groupBy(F.col(key).cast("string").alias("id")).agg(n.alias("n_gold"), *more_g).alias("g")
    p = predictions.groupBy(F.col(key).cast("string").alias("id")).agg(n.alias("n_pred"), *more_p).alias("p")
    both = g.join(p, F.col("g.id").eqNullSafe(F.col("p.id")), "full_outer")
    return both.select(F.coalesce("g.id", "p.id").alias("id"), *[c for c in (*g.columns, *p.columns) if c != "id"])


def align(gold: DataFrame, systems: Mapping[str, DataFrame], eval_sha256: str, key: str = "id") -> DataFrame:
    """The gold rows with one column of raw output for each system. Anything that doesn't fit raises, before a row is joined."""
    out = gold
    for name, predictions in systems.items():
        enforce(alignment_violations(gold, predictions, eval_sha256, key), f"{name} isn't aligned")
        out = out.join(predictions.select(key, F.col("raw_output").alias(name)), key)
    return out


def align_by_position(left: DataFrame, right: DataFrame, order: str = "ord", key: str | None = None) -> DataFrame:
    """Joins rows of equal position. A position that one side lacks or repeats, or at which the ids differ, raises."""
    enforce(id_violations(left, right, order), "positions differ")
    joined = left.alias("l").join(right.withColumnsRenamed({c: f"right_{c}" for c in right.columns}), F.col(f"l.{order}") == F.col(f"right_{order}"))
    if key:
        enforce(joined.where(~F.col(f"l.{key}").eqNullSafe(F.col(f"right_{key}"))).select(order), "ids differ by position")
    return joined.drop(f"right_{order}")


def score_classification(gold: DataFrame, predictions: DataFrame, labels: Sequence[str], key: str = "id", gold_label: str = "intent") -> DataFrame:
    """One row of scores. Repeated, missing or extra ids raise; outputs that aren't labels count as invalid."""
    enforce(id_violations(gold, predictions, key), "predictions don't match the gold rows")
    own = metrics.normalise(predictions, list(labels), "prediction", "raw_output").select(key, "prediction")
    return metrics.classification_score(metrics.confusion(gold.join(own, key), gold_label, "prediction"))


def gold_violations(rows: DataFrame, key: str, utterance: str, slots: str, types: Sequence[str] = TARGET_TYPES) -> DataFrame:
    """Gold rows that can't be scored: null text or slots, slots of an unknown type, without a value, or not in the text."""
    u, s = F.col(utterance), F.col(slots)
    any_ = lambda test: F.exists(s, lambda x: F.coalesce(test(x), F.lit(True)))
    tests = {
        "no_utterance": u.isNull(),
        "no_slots": s.isNull(),
        "unknown_type": any_(lambda x: ~x["type"].isin(*types)),
        "blank_value": any_(lambda x: x["value"] == ""),
        "not_in_utterance": any_(lambda x: ~u.contains(x["value"])),
    }
    return _listed(rows, key, tests)


def score_entities(rows: DataFrame, key: str, utterance: str, gold: str, pred: str) -> DataFrame:
    """``entity_prf`` with macro_f1 over the types. Gold that can't be scored raises."""
    enforce(gold_violations(rows, key, utterance, gold), "invalid gold")
    counts = metrics.entity_counts(rows, gold, pred, key)
    return metrics.entity_prf(counts).crossJoin(macro_f1(metrics.entity_prf_by_type(counts)))  # one row each


def macro_f1(by_type: DataFrame) -> DataFrame:
    """One row: the mean F1 of the types; a type without entities counts 0."""
    return by_type.agg(F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 9).alias("macro_f1"), F.count(F.lit(1)).alias("n_types"))


def eligible_for_confidence(parsed: str) -> Column:
    """A valid output with slots: nothing else needs a confidence."""
    p = F.col(parsed)
    return F.coalesce(p["json_valid"] & p["schema_valid"] & p["copy_valid"] & (F.size(p["slots"]) > 0), F.lit(False))


def with_confidence(rows: DataFrame, key: str, parsed: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds mean_logprob: ``score`` gets the eligible rows alone and returns (key, mean_logprob); all others are null."""
    scored = score(rows.where(eligible_for_confidence(parsed))).select(key, "mean_logprob")
    return rows.join(scored, key, "left")


def replacements(chosen: DataFrame) -> DataFrame:
    """One row: how often the hybrid took the new output."""
    return chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if("replaced").alias("n_replaced"))
