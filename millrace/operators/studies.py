"""Study builders: from a table of annotated utterances to disjoint splits, an audit and records, in one call.

A ``Plan`` says which splits are drawn how: natural holdouts first, off one ranking of all eligible groups, then steps
(split, bucket, quota) in order. Ranks are sha256 of the plan's prefix, what is drawn, and the key, joined by '|'. The
studies differ in their plan and in what earlier ones have reserved:

* balanced by bucket in every split: no holdouts, steps for each split (``held_only`` keys are left out of all but train);
* natural holdouts, then a training mix by bucket;
* a pool of candidates: no holdouts, steps of the training split alone;
* a single test: one holdout and no steps.

Groups travel by the hash of their key; the texts of a group meet nowhere but in its representative.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import hash_rank
from millrace.functions.spans import TARGET_TYPES
from millrace.tables import numbered, once

from . import checks, datasets, groups, sampling

NEGATIVES = ("hard_negative", "pure_negative")


@dataclass(frozen=True)
class Plan:
    prefix: tuple[str, ...]
    holdouts: tuple[tuple[str, int], ...] = ()
    steps: tuple[tuple[str, str, int], ...] = ()
    #: What stands for the bucket in the rank of a split's final order.
    order: str = "order"

    def rank(self, *parts: Column | str) -> Column:
        return hash_rank(*[F.lit(x) for x in self.prefix], *parts)

    def sizes(self) -> dict[str, int]:
        return {f"{s}/natural": n for s, n in self.holdouts} | {f"{s}/{b}": n for s, b, n in self.steps}


def training_mix(per_type: int, hard: int, pure: int, split: str = "train") -> tuple[tuple[str, str, int], ...]:
    return tuple((split, t, per_type) for t in TARGET_TYPES) + ((split, "hard_negative", hard), (split, "pure_negative", pure))


def source_violations(rows: DataFrame, partition: str = "train", locale: str | None = None) -> DataFrame:
    """(id, violation): repeated ids, rows of another partition or locale, rows without text."""
    tests = [F.when(~F.col("partition").eqNullSafe(F.lit(partition)), "foreign_partition"), F.when(F.coalesce(F.trim("utt"), F.lit("")) == "", "blank_utterance")]
    if locale:
        tests.append(F.when(~F.col("locale").eqNullSafe(F.lit(locale)), "foreign_locale"))
    odd = rows.select("id", F.explode(F.array_compact(F.array(*tests))).alias("violation"))
    return odd.unionByName(checks.dup_keys(rows, "id").select("id", F.lit("duplicate_id").alias("violation")))


def study_groups(rows: DataFrame, prior: DataFrame | None = None, reserved: DataFrame | None = None) -> DataFrame:
    """rows(id, utt, slots, any_type, key) -> a row for each key: key, group_sha256, n_members, status, id, utt, slots, types, negative.

    status: empty, prior (the key is in prior(key) or its hash in reserved(group_sha256)), conflict (its rows' slots differ) or eligible,
    in that order."""
    own = rows.select("id", "utt", "slots", "any_type", "key", F.sha2("key", 256).alias("group_sha256"), F.xxhash64(groups.slot_signature(F.col("slots"))).alias("_sig"))
    # one aggregate a column: what a study doesn't read, mostly the texts, doesn't cross the shuffle; the key is one for all members
    best = [F.min_by(c, groups.id_order("id")).alias(f"_{c}") for c in ("id", "utt", "slots", "any_type")]
    g = own.groupBy("group_sha256").agg(F.count(F.lit(1)).alias("n_members"), (~F.min("_sig").eqNullSafe(F.max("_sig"))).alias("_differ"), F.first("key").alias("_key"), *best)
    used = [x for x in (prior.select(F.sha2("key", 256).alias("group_sha256")) if prior is not None else None, reserved.select("group_sha256") if reserved is not None else None) if x is not None]
    taken = F.lit(False)
    if used:
        out = used[0] if len(used) == 1 else used[0].unionByName(used[1])
        g = g.join(out.distinct().withColumn("_taken", F.lit(True)), "group_sha256", "left")
        taken = F.coalesce(F.col("_taken"), F.lit(False))
    status = F.when(F.col("_key") == "", "empty").when(taken, "prior").when(F.col("_differ"), "conflict").otherwise("eligible")
    negative = F.when(F.size("_slots") == 0, F.when(F.col("_any_type"), "hard_negative").otherwise("pure_negative"))
    shown = [F.col(f"_{c}").alias(c) for c in ("id", "utt", "slots")]
    return g.select(F.col("_key").alias("key"), "group_sha256", "n_members", status.alias("status"), *shown, F.array_sort(F.array_distinct("_slots.type")).alias("types"), negative.alias("negative"))


def study_audit(study: DataFrame) -> DataFrame:
    """One row of counters over ``study_groups``."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}_groups")
    ok = F.col("status") == "eligible"
    return study.agg(
        F.sum("n_members").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), *[n(s) for s in ("empty", "prior", "conflict", "eligible")],
        F.coalesce(F.sum(F.when(F.col("status") == "conflict", F.col("n_members"))), F.lit(0)).cast("long").alias("n_conflict_rows"),
        F.count_if(ok & (F.size("slots") > 0)).alias("n_positive"),
        *[F.count_if(ok & F.array_contains("types", t)).alias(f"n_{t}") for t in TARGET_TYPES], *[F.count_if(ok & (F.col("negative") == x)).alias(f"n_{x}") for x in NEGATIVES],
    )


def draw(study: DataFrame, plan: Plan, held_only: DataFrame | None = None) -> DataFrame:
    """(split, bucket, key, ord) of the plan's splits. ``held_only``(key): keys that may stand in no split but train."""
    free = study.where("status = 'eligible'").select("key", "types", "negative")
    parts = []
    if plan.holdouts:
        ranked = free.select("key", plan.rank(F.lit("natural"), "key").alias("rank"))
        held = sampling.natural_holdout(ranked, "rank", "key", plan.holdouts).select("split", F.lit("natural").alias("bucket"), "key")
        parts.append(held)
        free = free.join(held.select("key"), "key", "left_anti")
    if plan.steps:
        buckets = F.concat(F.col("types"), F.when(F.col("negative").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("negative", F.lit("none"))))
        splits = F.array(*[F.lit(s) for s in dict.fromkeys(s for s, *_ in plan.steps)])
        c = free.select("key", F.explode(buckets).alias("bucket")).select("key", "bucket", F.explode(splits).alias("split"))
        if held_only is not None:
            c = c.join(held_only.select("key", F.lit(True).alias("_held")).distinct(), "key", "left").where("_held is null or split = 'train'").drop("_held")
        parts.append(sampling.quota_sample(c.withColumn("rank", plan.rank("split", "bucket", "key")), plan.steps).select("split", "bucket", "key"))
    drawn = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ranked = drawn.withColumn("_rank", plan.rank("split", F.lit(plan.order), "key"))
    return numbered(ranked, ["split"], ["_rank", "key"], "ord", sum(plan.sizes().values())).drop("_rank")


def shortfalls(drawn: DataFrame, plan: Plan) -> DataFrame:
    """Splits and buckets that got another number of groups than planned."""
    return checks.count_mismatch(drawn.select(F.concat_ws("/", "split", "bucket").alias("place")), "place", plan.sizes())


def build(rows: DataFrame, plan: Plan, prior: DataFrame | None = None, reserved: DataFrame | None = None, held_only: DataFrame | None = None, locale: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, audit) of a study on rows(id, partition, utt, slots, any_type, key). Raises on an invalid source and on any shortfall."""
    checks.enforce(source_violations(rows, locale=locale), "invalid source rows")
    study = study_groups(rows, prior, reserved)
    drawn = draw(study, plan, held_only)
    checks.enforce(shortfalls(drawn, plan), "too few groups")
    return records(study, drawn), study_audit(study)


def records(study: DataFrame, drawn: DataFrame) -> DataFrame:
    """The record of each drawn group: split, ord, bucket, id, utt, slots, group_sha256, prompt and completion."""
    rows = drawn.join(study.where("status = 'eligible'").drop("n_members", "status", "types", "negative"), "key")
    return datasets.sft_records(rows, F.col("utt"), "slots", "split", "ord", "bucket", "id", "utt", "slots", "group_sha256")


def reserve(earlier: Sequence[DataFrame], name: str, new: DataFrame) -> DataFrame:
    """All reserved hashes with a study's own added. A hash that an earlier study holds raises."""
    sets = {str(i): x for i, x in enumerate(earlier)} | {name: new}
    checks.enforce(checks.reserved_overlap(sets, "group_sha256"), f"{name} shares groups with an earlier study")
    return groups.prior_keys([*earlier, new], "group_sha256")


def sealed_summary(recorded: DataFrame, sealed: Sequence[str] = ("test",)) -> DataFrame:
    """(split, n, n_positive): what a public manifest may say; of a sealed split the number of rows alone."""
    counts = recorded.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("slots") > 0).alias("_p"))
    return counts.select("split", "n", F.when(~F.col("split").isin(*sealed), F.col("_p")).alias("n_positive"))


def preference_records(parsed: DataFrame, utterance: str, slots: str, predicted: str, raw: str, digest: str, *keep: str) -> DataFrame:
    """Prompt, chosen and rejected turns, and is_model_error: a wrong, non-blank model output is the rejected answer, else one made up."""
    from millrace.functions.keys import strip
    from millrace.functions.spans import canonical_json

    from .metrics import same_multiset

    wrong = ~same_multiset(F.col(slots), F.col(predicted)) & (F.coalesce(strip(F.col(raw)), F.lit("")) != "")
    made = datasets.fallback_rejected(F.col(slots), F.col(utterance), F.col(digest))
    rejected = F.when(wrong, F.col(raw)).otherwise(made)
    out = parsed.select(*keep, datasets.turn("user", F.concat(F.lit(datasets.SLOT_PROMPT), utterance)).alias("prompt"), datasets.turn("assistant", canonical_json(F.col(slots))).alias("chosen"), rejected.alias("_r"), wrong.alias("is_model_error"))
    out = once(out, _r=F.col("_r"))
    return out.where("_r is not null").withColumn("rejected", datasets.turn("assistant", F.col("_r"))).drop("_r")


def preference_audit(pairs: DataFrame) -> DataFrame:
    """One row: pairs, those that show a model's own error, and pairs whose two answers are equal (which there must not be)."""
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_model_error").alias("n_model_error"), F.count_if(~F.col("is_model_error")).alias("n_fallback"), F.count_if(F.col("chosen") == F.col("rejected")).alias("n_equal"))
