"""Studies built from the annotated utterances: splits, audits, series of studies, preference records."""

from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.hashing import bucket_hash
from millrace.operators import studies
from millrace.operators.studies import Plan

from . import entities, sampling
from .fixtures import H

NATURAL = Plan(("v2", "20260101"), (("confirmation", 60), ("dev", 40)), studies.training_mix(12, 20, 20))
BALANCED = Plan(("20260101",), (), tuple((s, b, n) for s, n in (("confirmation", 8), ("dev", 5), ("train", 12)) for b in (*studies.TARGET_TYPES, "none")))
POOL = Plan(("v2", "3"), (), studies.training_mix(10, 15, 15))
TEST = Plan(("v2", "5"), (("test", 50),))


def source(spark, sf_dir):
    """(rows of the training partition, keys of held-out ones, hashes that earlier studies reserved)."""
    k = sampling.keyed(spark, sf_dir).withColumnsRenamed({"strong": "key", "part": "partition"})
    train = k.where("partition = 'train'")
    reserved = train.where(bucket_hash("reserved", "key") % 11 == 0).select(F.sha2("key", 256).alias("group_sha256")).distinct()
    return train, k.where("partition <> 'train'").select("key").distinct(), reserved


def _study(spark, sf_dir):
    return studies.study_groups(*source(spark, sf_dir))


def study_audit(spark, sf_dir):
    return studies.study_audit(_study(spark, sf_dir))


def _hashed(drawn):
    return drawn.select("split", "bucket", F.sha2("key", 256).alias("group_sha256"), "ord")


def study_splits(spark, sf_dir):
    """Natural holdouts, then a training mix."""
    return _hashed(studies.draw(_study(spark, sf_dir), NATURAL))


def study_balanced(spark, sf_dir):
    """Buckets in every split; keys seen before may stand in the training split alone."""
    s = _study(spark, sf_dir)
    return _hashed(studies.draw(s, BALANCED, s.where(bucket_hash("held", "key") % 9 == 0).select("key")))


def study_series(spark, sf_dir):
    """A pool of candidates, and a test that shares nothing with it."""
    train, prior, reserved = source(spark, sf_dir)
    pool = studies.draw(studies.study_groups(train, prior, reserved), POOL)
    more = studies.reserve([reserved], "pool", pool.select(F.sha2("key", 256).alias("group_sha256")))
    return _hashed(pool).unionByName(_hashed(studies.draw(studies.study_groups(train, prior, more), TEST)))


def study_summary(spark, sf_dir):
    """What a manifest says of the records: the confirmation split is sealed."""
    s = _study(spark, sf_dir)
    out = studies.sealed_summary(studies.records(s, studies.draw(s, NATURAL)), ("confirmation",))
    return out.select("split", "n", F.coalesce("n_positive", F.lit(-1)).alias("n_positive"))


def study_shortfalls(spark, sf_dir):
    return studies.shortfalls(studies.draw(_study(spark, sf_dir), Plan(("v2", "9"), (("dev", 30),), (("train", "date", 10_000_000), ("train", "person", 3)))), Plan(("v2", "9"), (("dev", 30),), (("train", "date", 10_000_000), ("train", "person", 3))))


def preference_audit(spark, sf_dir):
    p = entities.parsed(spark, sf_dir).withColumns({"pred": F.col("p.slots"), "digest": F.sha2(keys.key_strong(F.col("utt")), 256)})
    return studies.preference_audit(studies.preference_records(p, "utt", "slots", "pred", "raw_output", "digest", "id"))


STUDY = sampling.KEYED + f""", held AS (SELECT DISTINCT strong FROM keyed WHERE part <> 'train'), sg AS (SELECT strong, count(*) AS n_members, count(DISTINCT sig) AS n_sig, min(id) AS id FROM keyed WHERE part = 'train' GROUP BY strong),
study AS MATERIALIZED (SELECT g.strong AS key, n_members, CASE WHEN g.strong = '' THEN 'empty' WHEN g.strong IN (SELECT strong FROM held) OR {H('reserved', 'g.strong')} % 11 = 0 THEN 'prior' WHEN n_sig > 1 THEN 'conflict' ELSE 'eligible' END AS status,
    r.slots, list_distinct(list_transform(r.slots, lambda s: s.type)) AS types, CASE WHEN len(r.slots) > 0 THEN NULL WHEN r.any_type THEN 'hard_negative' ELSE 'pure_negative' END AS negative FROM sg g JOIN keyed r USING (id))"""


def _draw_sql(name: str, plan: Plan, taken: str | None = None, held: str | None = None) -> str:
    """CTEs that draw a plan from study; the last is called name."""
    prefix = "|".join(plan.prefix)
    free = "status = 'eligible'" + (f" AND key NOT IN (SELECT key FROM {taken})" if taken else "")
    parts, used = [], []
    if plan.holdouts:
        upto, case = 0, "CASE"
        for split, n in plan.holdouts:
            upto += n
            case += f" WHEN r <= {upto} THEN '{split}'"
        parts.append(f"{name}_n AS MATERIALIZED (SELECT {case} END AS split, 'natural' AS bucket, key FROM (SELECT key, row_number() OVER (ORDER BY sha256('{prefix}|natural|' || key), key) AS r FROM study WHERE {free}) WHERE r <= {upto})")
        used.append(f"{name}_n")
    for i, (split, bucket, quota) in enumerate(plan.steps):
        test = f"list_contains(types, '{bucket}')" if bucket in studies.TARGET_TYPES else "negative IS NOT NULL" if bucket == "none" else f"negative = '{bucket}'"
        gone = "".join(f" AND key NOT IN (SELECT key FROM {u})" for u in used) + (f" AND NOT ({held})" if held and split != "train" else "")
        parts.append(f"{name}_{i} AS MATERIALIZED (SELECT '{split}' AS split, '{bucket}' AS bucket, key FROM study WHERE {free} AND {test}{gone} ORDER BY sha256('{prefix}|{split}|{bucket}|' || key), key LIMIT {quota})")
        used.append(f"{name}_{i}")
    every = " UNION ALL ".join(f"SELECT * FROM {u}" for u in used)
    return ", ".join(parts) + f", {name} AS MATERIALIZED (SELECT split, bucket, key, row_number() OVER (PARTITION BY split ORDER BY sha256('{prefix}|' || split || '|order|' || key), key) AS ord FROM ({every}))"


_OUT = "SELECT split, bucket, sha256(key) AS group_sha256, ord FROM {}"
_TYPES = ", ".join(f"count(*) FILTER (status = 'eligible' AND list_contains(types, '{t}')) AS n_{t}" for t in studies.TARGET_TYPES)
_NEGATIVES = ", ".join(f"count(*) FILTER (status = 'eligible' AND negative = '{x}') AS n_{x}" for x in studies.NEGATIVES)

QUERIES = {
    "study_audit": (
        study_audit,
        f"WITH {STUDY} SELECT sum(n_members)::BIGINT AS n_rows, count(*) AS n_groups, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}_groups" for s in ("empty", "prior", "conflict", "eligible"))
        + f", coalesce(sum(n_members) FILTER (status = 'conflict'), 0)::BIGINT AS n_conflict_rows, count(*) FILTER (status = 'eligible' AND len(slots) > 0) AS n_positive, {_TYPES}, {_NEGATIVES} FROM study",
    ),
    "study_splits": (study_splits, f"WITH {STUDY}, {_draw_sql('d', NATURAL)} {_OUT.format('d')}"),
    "study_balanced": (study_balanced, f"WITH {STUDY}, {_draw_sql('d', BALANCED, held=H('held', 'key') + ' % 9 = 0')} {_OUT.format('d')}"),
    "study_series": (study_series, f"WITH {STUDY}, {_draw_sql('p', POOL)}, {_draw_sql('t', TEST, taken='p')} {_OUT.format('p')} UNION ALL {_OUT.format('t')}"),
    "study_summary": (
        study_summary,
        f"WITH {STUDY}, {_draw_sql('d', NATURAL)} SELECT split, count(*) AS n, CASE WHEN split <> 'confirmation' THEN count(*) FILTER (len(slots) > 0) ELSE -1 END AS n_positive FROM d JOIN study USING (key) GROUP BY split",
    ),
    "study_shortfalls": (
        study_shortfalls,
        f"WITH {STUDY}, n AS (SELECT count(*) FILTER (status = 'eligible') AS n FROM study), {_draw_sql('d', Plan(('v2', '9'), (('dev', 30),), (('train', 'date', 10_000_000), ('train', 'person', 3))))}, have AS (SELECT split || '/' || bucket AS place, count(*) AS n FROM d GROUP BY ALL) "
        "SELECT place, expected, coalesce(h.n, 0) AS n FROM (VALUES ('dev/natural', 30::BIGINT), ('train/date', 10000000), ('train/person', 3)) p(place, expected) LEFT JOIN have h USING (place) WHERE coalesce(h.n, 0) <> expected",
    ),
    "preference_audit": (
        preference_audit,
        f"WITH {entities.PARSED}, w AS (SELECT utt, slots, (pred IS NULL OR list_sort(pred) <> list_sort(slots)) AND trim(raw_output) <> '' AS wrong FROM parsed), k AS (SELECT * FROM w WHERE wrong OR len(slots) > 0 OR regexp_matches(utt, '[\\p{{L}}\\p{{N}}]')) "
        "SELECT count(*) AS n, count(*) FILTER (wrong) AS n_model_error, count(*) FILTER (NOT wrong) AS n_fallback, 0::BIGINT AS n_equal FROM k",
    ),
}
