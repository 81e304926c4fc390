"""Groups of annotated utterances, eligibility, draws."""

from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.hashing import hash_rank
from millrace.functions.spans import TARGET_TYPES
from millrace.operators import groups, sampling

from .fixtures import FOLD, UTTS, documents, table, utterances

SEED = "20260101"
KEYED = UTTS + f""", keyed AS (SELECT *, regexp_replace({FOLD.replace("text", "utt")}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g') AS strong, to_json(list_sort(slots))::VARCHAR AS sig FROM utts)"""
GROUPS = KEYED + """, prior_keys AS (SELECT DISTINCT strong FROM keyed WHERE part <> 'train'),
open_rows AS (SELECT * FROM keyed WHERE part = 'train' AND strong <> '' AND strong NOT IN (SELECT strong FROM prior_keys)),
grouped AS (SELECT strong, count(*) AS n_members, count(DISTINCT sig) AS n_sig, min(id) AS id FROM open_rows GROUP BY strong),
eligible AS (SELECT sha256(g.strong) AS key, g.id, g.n_members, r.utt, r.slots, r.scenario, list_sort(list_distinct(list_transform(r.slots, lambda s: s.type))) AS types,
    CASE WHEN len(r.slots) > 0 THEN NULL WHEN r.any_type THEN 'hard_negative' ELSE 'pure_negative' END AS negative FROM grouped g JOIN open_rows r USING (id) WHERE n_sig = 1)"""


def keyed(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return u.withColumns({"strong": keys.key_strong(F.col("utt")), "sig": groups.slot_signature(F.col("slots"))})


def open_rows(spark, sf_dir):
    """Training rows with a key that no held-out row has: the exclusions come before conflicts are looked for."""
    k = keyed(spark, sf_dir)
    held = groups.prior_keys([k.where("part <> 'train'")], "strong")
    return groups.without(k.where("part = 'train' and strong <> ''"), held, "strong")


def negative_of(slots, any_type):
    return F.when(F.size(slots) == 0, F.when(any_type, "hard_negative").otherwise("pure_negative"))


def eligible(spark, sf_dir):
    rows = open_rows(spark, sf_dir)
    best = F.min_by(F.struct("id", "utt", "slots", "scenario", "any_type"), groups.id_order("id")).alias("r")
    g = rows.groupBy("strong").agg(F.count(F.lit(1)).alias("n_members"), F.count_distinct("sig").alias("n_sig"), best).where("n_sig = 1")
    return g.select(
        F.sha2("strong", 256).alias("key"), "r.id", "n_members", "r.utt", "r.slots", "r.scenario",
        F.array_sort(F.array_distinct("r.slots.type")).alias("types"), negative_of(F.col("r.slots"), F.col("r.any_type")).alias("negative"),
    )


def phrase_groups(spark, sf_dir):
    g = groups.phrase_groups(keyed(spark, sf_dir), "strong", "id")
    return g.select(F.sha2("strong", 256).alias("group_sha256"), "n_members", "first_id")


def conflict_groups(spark, sf_dir):
    g = groups.conflict_groups(keyed(spark, sf_dir), "strong", F.col("sig"))
    return g.select(F.sha2("strong", 256).alias("group_sha256"), "n_rows", "n_signatures")


def group_representative(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("sid", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string")))
    return groups.representative(d, "strong", "sid", "source").select("sid", "source", "n_members")


def negative_kind(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return u.select("id", negative_of(F.col("slots"), F.col("any_type")).alias("negative"))


def hash_ranked(spark, sf_dir):
    return utterances(spark, sf_dir).select("id", hash_rank(F.lit("v2"), F.lit(SEED), F.lit("natural"), "id").alias("rank"))


def natural_holdout(spark, sf_dir):
    e = eligible(spark, sf_dir).select("key", hash_rank(F.lit("v2"), F.lit(SEED), F.lit("natural"), "key").alias("rank"))
    return sampling.natural_holdout(e, "rank", "key", [("confirmation", 200), ("dev", 100)]).select("key", "split", "ord")


def topk_per_bucket(spark, sf_dir):
    e = eligible(spark, sf_dir).select("scenario", "key", hash_rank(F.lit(SEED), F.lit("dpo"), "scenario", "key").alias("rank"))
    return sampling.topk_per_bucket(e, ["scenario"], ["rank", "key"], 16).select("scenario", "key", "rn")


BUCKETS = (*TARGET_TYPES, "hard_negative", "pure_negative")
STEPS = [(split, bucket, quota) for split, quota in (("confirmation", 20), ("dev", 10), ("train", 40)) for bucket in BUCKETS]


def quota_sample(spark, sf_dir):
    e = eligible(spark, sf_dir)
    buckets = F.concat(F.col("types"), F.when(F.col("negative").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("negative")))
    split = F.explode(F.array(*map(F.lit, ("confirmation", "dev", "train"))))
    c = e.select("key", F.explode(buckets).alias("bucket")).select("key", "bucket", split.alias("split"))
    c = c.withColumn("rank", hash_rank(F.lit(SEED), "split", "bucket", "key"))
    return sampling.quota_sample(c, STEPS)


def _quota_sql():
    parts, used = [], []
    for i, (split, bucket, quota) in enumerate(STEPS):
        test = f"list_contains(types, '{bucket}')" if bucket in TARGET_TYPES else f"negative = '{bucket}'"
        free = "".join(f" AND key NOT IN (SELECT key FROM {u})" for u in used)
        parts.append(f"q{i} AS MATERIALIZED (SELECT '{split}' AS split, '{bucket}' AS bucket, key, row_number() OVER (ORDER BY r, key) AS ord FROM (SELECT key, sha256('{SEED}|{split}|{bucket}|' || key) AS r FROM eligible WHERE {test}{free} ORDER BY r, key LIMIT {quota}))")
        used.append(f"q{i}")
    return f"WITH {GROUPS.replace('eligible AS (', 'eligible AS MATERIALIZED (')}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM {u}" for u in used)


def _ranked_docs(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", "lang", F.sha2("alnum", 256).alias("key"), hash_rank(F.lit(SEED), "lang", "doc_id").alias("rank"))


def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(_ranked_docs(spark, sf_dir), "lang", "rank", "doc_id", 60).select("doc_id", "lang", "rn")


def stratified_subset(spark, sf_dir):
    return sampling.stratified_subset(_ranked_docs(spark, sf_dir), "lang", "rank", "doc_id", 150).select("doc_id", "lang", "rn")


def unique_take(spark, sf_dir):
    return sampling.unique_take(_ranked_docs(spark, sf_dir), "lang", "key", "rank", 8, 4)


_RANKED = "ranked AS (SELECT doc_id, lang, alnum, sha256('" + SEED + "|' || lang || '|' || doc_id) AS rank FROM docs)"


def _unique_sql():
    from .fixtures import DOCS, LABELS

    parts, used = [], []
    for i, label in enumerate(LABELS):
        free = "".join(f" AND key NOT IN (SELECT key FROM t{j})" for j in range(i))
        parts.append(f"t{i} AS MATERIALIZED (SELECT lang, key, min(rank) AS rank FROM (SELECT lang, sha256(alnum) AS key, rank FROM ranked) WHERE lang = '{label}'{free} GROUP BY ALL ORDER BY rank, key LIMIT 8)")
        used.append(f"SELECT * FROM t{i}")
    return f"WITH {DOCS}, {_RANKED}, " + ", ".join(parts) + " " + " UNION ALL ".join(used)


def selection_audit(spark, sf_dir):
    """Counters in the order of exclusions: empty key, held-out key, conflict."""
    k = keyed(spark, sf_dir).where("part = 'train'")
    held = groups.prior_keys([keyed(spark, sf_dir).where("part <> 'train' and strong <> ''")], "strong").withColumn("held", F.lit(True))
    g = k.join(held, "strong", "left").groupBy("strong").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sig").alias("s"), F.bool_or(F.coalesce("held", F.lit(False))).alias("held"))
    empty, conflict = F.col("strong") == "", (F.col("strong") != "") & ~F.col("held") & (F.col("s") > 1)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return g.agg(
        F.sum("n").alias("n_rows"), total(empty).alias("n_empty_rows"), total(~empty & F.col("held")).alias("n_prior_rows"), F.count_if(~empty & F.col("held")).alias("n_prior_groups"),
        F.count_if(conflict).alias("n_conflict_groups"), total(conflict).alias("n_conflict_rows"), F.count_if(~empty & ~F.col("held") & (F.col("s") == 1)).alias("n_eligible"),
    )


def label_shortfall(spark, sf_dir):
    e = eligible(spark, sf_dir)
    return sampling.shortfall(e.where("negative = 'hard_negative'"), table(spark, sf_dir, "documents").select(F.col("source").alias("scenario")), "scenario", 35)


def probe_rows(spark, sf_dir):
    return sampling.probe_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "rn")


def _docs_sql(rest):
    from .fixtures import DOCS

    return f"WITH {DOCS}, {_RANKED} {rest}"


QUERIES = {
    "phrase_groups": (phrase_groups, f"WITH {KEYED} SELECT sha256(strong) AS group_sha256, count(*) AS n_members, min(id) AS first_id FROM keyed GROUP BY strong"),
    "conflict_groups": (conflict_groups, f"WITH {KEYED} SELECT sha256(strong) AS group_sha256, count(*) AS n_rows, count(DISTINCT sig) AS n_signatures FROM keyed GROUP BY strong HAVING n_signatures > 1"),
    "group_representative": (
        group_representative,
        _docs_sql(", s AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS sid FROM docs) SELECT sid, source, n AS n_members FROM (SELECT *, count(*) OVER (PARTITION BY strong) AS n, row_number() OVER (PARTITION BY strong ORDER BY sid LIKE 'x%', TRY_CAST(sid AS BIGINT), sid) AS rn FROM s) WHERE rn = 1"),
    ),
    "negative_kind": (negative_kind, f"WITH {UTTS} SELECT id, CASE WHEN len(slots) > 0 THEN NULL WHEN any_type THEN 'hard_negative' ELSE 'pure_negative' END AS negative FROM utts"),
    "hash_rank": (hash_ranked, f"WITH {UTTS} SELECT id, sha256('v2|{SEED}|natural|' || id) AS rank FROM utts"),
    "natural_holdout": (
        natural_holdout,
        f"WITH {GROUPS} SELECT key, CASE WHEN ord <= 200 THEN 'confirmation' ELSE 'dev' END AS split, ord FROM (SELECT key, row_number() OVER (ORDER BY sha256('v2|{SEED}|natural|' || key), key) AS ord FROM eligible) WHERE ord <= 300",
    ),
    "topk_per_bucket": (topk_per_bucket, f"WITH {GROUPS} SELECT scenario, key, rn FROM (SELECT scenario, key, row_number() OVER (PARTITION BY scenario ORDER BY sha256('{SEED}|dpo|' || scenario || '|' || key), key) AS rn FROM eligible) WHERE rn <= 16"),
    "quota_sample": (quota_sample, _quota_sql()),
    "balanced_sample": (balanced_sample, _docs_sql("SELECT doc_id, lang, rn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank, doc_id) AS rn FROM ranked) WHERE rn <= 60")),
    "stratified_subset": (stratified_subset, _docs_sql("SELECT doc_id, lang, rn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank, doc_id) AS rn FROM ranked) ORDER BY rn, lang LIMIT 150")),
    "unique_take": (unique_take, _unique_sql()),
    "selection_audit": (
        selection_audit,
        f"""WITH {KEYED}, g AS (SELECT strong, count(*) AS n, count(DISTINCT sig) AS s, strong IN (SELECT strong FROM keyed WHERE part <> 'train' AND strong <> '') AS held FROM keyed WHERE part = 'train' GROUP BY strong)
        SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (strong = ''), 0)::BIGINT AS n_empty_rows, coalesce(sum(n) FILTER (strong <> '' AND held), 0)::BIGINT AS n_prior_rows, count(*) FILTER (strong <> '' AND held) AS n_prior_groups,
        count(*) FILTER (strong <> '' AND NOT held AND s > 1) AS n_conflict_groups, coalesce(sum(n) FILTER (strong <> '' AND NOT held AND s > 1), 0)::BIGINT AS n_conflict_rows, count(*) FILTER (strong <> '' AND NOT held AND s = 1) AS n_eligible FROM g""",
    ),
    "label_shortfall": (
        label_shortfall,
        f"WITH {GROUPS} SELECT scenario, coalesce(n, 0) AS n FROM (SELECT DISTINCT source AS scenario FROM documents) LEFT JOIN (SELECT scenario, count(*) AS n FROM eligible WHERE negative = 'hard_negative' GROUP BY scenario) USING (scenario) WHERE coalesce(n, 0) < 35",
    ),
    "probe_rows": (probe_rows, "SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn IN (1, n, n // 2 + 1)"),
}
