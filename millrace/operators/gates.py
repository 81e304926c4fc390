"""Decision rules over metric tables, and reconciliation of reports.

Rates that a rule states as fractions are compared by cross-multiplication of the counts, so 3/10 is exact.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import ConstraintError

SLACK = 1e-12


def _at_least(c: str, low: float, slack: float = 0.0) -> Column:
    return F.coalesce(F.col(c) >= low - slack, F.lit(False))


def _share_at_most(count: str, base: str, num: int, den: int) -> Column:
    return F.coalesce((F.col(base) > 0) & (den * F.col(count) <= num * F.col(base)), F.lit(False))


def _positive(c: str) -> Column:
    return F.coalesce(F.col(c) > 0, F.lit(False))


def _validity(slack: float = 0.0) -> dict[str, Column]:
    return {f"{k}_at_least_95pct": _at_least(f"{k}_rate", 0.95, slack) for k in ("json_valid", "schema_valid", "copy_valid")}


def gates() -> dict[str, dict[str, Column]]:
    """The checks of each gate, over columns micro_f1, positive_f1, *_rate, n_no_slot_failure, n_no_slot, delta_low, reduction_low."""
    f55, f60 = {"strict_entity_f1_at_least_55pct": _at_least("micro_f1", 0.55)}, {"strict_entity_f1_at_least_60pct": _at_least("micro_f1", 0.60)}
    positive = {"positive_subset_f1_at_least_60pct": _at_least("positive_f1", 0.60)}
    few, fewer = ({f"no_slot_failure_at_most_{p}pct": _share_at_most("n_no_slot_failure", "n_no_slot", p, 100)} for p in (30, 20))
    better, seldomer = {"paired_f1_ci95_lower_positive": _positive("delta_low")}, {"paired_no_slot_reduction_ci95_lower_positive": _positive("reduction_low")}
    return {
        "v2": _validity(SLACK) | few,
        "v3": _validity() | few | f55 | positive | better | seldomer,
        "v4": f55 | positive | few | _validity() | better,
        "v5": f60 | positive | fewer | _validity() | better,
        "v6_dev": f60 | positive | fewer | _validity(),
        "v6_test": f60 | positive | fewer | _validity() | {"new_hybrid_minus_old_v5_hybrid_ci95_lower_positive": _positive("delta_low")},
        "v2_confirmation": better | seldomer | few,
    }


def improvement_gate(delta: str = "delta", low: str = "delta_low", least: float = 0.02) -> Column:
    """The paired gain is large enough and its interval lies above zero."""
    return F.coalesce((F.col(delta) >= least) & (F.col(low) > 0), F.lit(False))


def gate_checks(metrics: DataFrame, *keys: str, rules: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """(keys, gate, check, passed, gate_passed): a row for each check of each gate."""
    rules = rules or gates()
    rows = [F.struct(F.lit(g).alias("gate"), F.lit(c).alias("check"), test.alias("passed"), F.forall(F.array(*checks.values()), lambda x: x).alias("gate_passed")) for g, checks in rules.items() for c, test in checks.items()]
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def choose_checkpoint(candidates: DataFrame) -> DataFrame:
    """Of the eligible candidates(system, step, micro_f1, n_no_slot_failure, n_no_slot, *_rate) the one with the highest F1, then the
    fewest failures, then the first step. No row if none is eligible."""
    ok = F.forall(F.array(*gates()["v2"].values()), lambda x: x)
    return candidates.where(ok).orderBy(F.desc("micro_f1"), F.col("n_no_slot_failure") / F.col("n_no_slot"), "step").limit(1)


def require_checkpoint(candidates: DataFrame) -> DataFrame:
    """``choose_checkpoint``; raises if none is eligible."""
    best = choose_checkpoint(candidates)
    if not best.take(1):
        raise ConstraintError("no eligible checkpoint")
    return best


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest macro-F1, then accuracy; the first in order wins ties."""
    return candidates.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "ord").limit(1)


def system_pairs(systems: DataFrame, order: str, name: str, value: str) -> DataFrame:
    """Every unordered pair of systems, with the difference of a value. There are a handful of systems."""
    a, b = systems.alias("a"), systems.alias("b")
    return a.join(F.broadcast(b), F.col(f"a.{order}") < F.col(f"b.{order}")).select(F.col(f"a.{name}").alias("reference"), F.col(f"b.{name}").alias("candidate"), F.round(F.col(f"b.{value}") - F.col(f"a.{value}"), 9).alias("delta"))


def cross_check(left: DataFrame, right: DataFrame, name: str, *values: str) -> DataFrame:
    """(name, value, passed): whether two reports give a system the same values; a system that one lacks fails."""
    l, r = left.select(name, *[F.col(v).alias(f"l_{v}") for v in values], F.lit(True).alias("_l")), right.select(name, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(True).alias("_r"))
    both = l.join(r, name, "full_outer")
    same = lambda v: F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.coalesce(F.abs(F.col(f"l_{v}") - F.col(f"r_{v}")) <= SLACK, F.col(f"l_{v}").isNull() & F.col(f"r_{v}").isNull())
    return both.select(name, F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.coalesce(same(v), F.lit(False)).alias("passed")) for v in values])).alias("c")).select(name, "c.*")


def comparison_report(systems: DataFrame, order: str, name: str, value: str, *keys: str) -> dict[str, DataFrame]:
    """A report of several systems from one row of metrics each: the systems, their pairs, their gates and whether their figures
    reconcile."""
    return {"systems": systems, "pairs": system_pairs(systems, order, name, value), "gates": gate_checks(systems, name, *keys), "checks": reconcile(systems, name)}


def reconcile(report: DataFrame, *keys: str) -> DataFrame:
    """(keys, check, passed): whether a report's rates follow from its counts and its counts from each other."""
    near = lambda a, b: F.coalesce(F.abs(a - b) <= SLACK, a.isNull() & b.isNull())
    c = F.col
    checks = {
        "micro_f1": near(c("micro_f1"), F.try_divide(2.0 * c("tp"), 2.0 * c("tp") + c("fp") + c("fn"))),
        "gold_slots": c("gold_slot_count") == c("tp") + c("fn"),
        "predicted_slots": c("predicted_slot_count") == c("tp") + c("fp"),
        "failures_within_examples": (c("n_no_slot_fp") + c("n_no_slot_invalid") <= c("n_no_slot")) & (c("n_no_slot") <= c("n")),
        "failure_rate": near(c("failure_rate"), F.try_divide(c("n_no_slot_fp") + c("n_no_slot_invalid"), c("n_no_slot"))),
        "validity_falls": (c("copy_valid_rate") <= c("schema_valid_rate")) & (c("schema_valid_rate") <= c("json_valid_rate")),
        "positive_within_examples": c("n") >= c("n_exact"),
        "precision": near(c("precision"), F.coalesce(F.try_divide(c("tp"), c("tp") + c("fp")), F.lit(0.0))),
        "recall": near(c("recall"), F.coalesce(F.try_divide(c("tp"), c("tp") + c("fn")), F.lit(0.0))),
        "exact_rate": near(c("exact_rate"), F.try_divide(c("n_exact"), c("n"))),
        "invalid_count": near(c("copy_valid_rate"), 1 - F.try_divide(c("n_invalid"), c("n"))),
        "rates_in_range": F.forall(F.array("json_valid_rate", "schema_valid_rate", "copy_valid_rate", "failure_rate"), lambda x: ~F.isnan(x) & (x >= 0) & (x <= 1)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    return report.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def triage_requests(df: DataFrame, body: str, most_chars: int = 20, most_bytes: int = 100, most_tokens: int = 512, tokens: Column | None = None) -> DataFrame:
    """Adds status and code of each request body: the rules of a service that takes {"text": ...}, in order."""
    b = F.col(body)
    kind = F.schema_of_variant(F.try_parse_json(b))
    text = F.get_json_object(b, "$.text")
    plain = F.coalesce(kind == "OBJECT<text: STRING>", F.lit(False))
    blank = F.regexp_replace(text, r"[\p{IsWhite_Space}\x1c-\x1f]", "") == ""
    cases = [
        (F.octet_length(b) > most_bytes, 413, "body_too_large"),
        (~plain, 400, "invalid_request"),
        (blank, 400, "empty_text"),
        (F.length(text) > most_chars, 413, "text_too_long"),
        ((tokens if tokens is not None else F.length(text)) > most_tokens, 413, "prompt_too_long"),
    ]
    status, code = F.lit(200), F.lit("ok")
    for test, s, name in reversed(cases):
        status, code = F.when(test, s).otherwise(status), F.when(test, name).otherwise(code)
    return df.withColumn("status", status.cast("long")).withColumn("code", code)


def latest(df: DataFrame, path: str) -> DataFrame:
    """The path with the highest number at its end."""
    return df.agg(F.max_by(path, F.regexp_extract(path, r"(\d+)$", 1).cast("long")).alias(path))


