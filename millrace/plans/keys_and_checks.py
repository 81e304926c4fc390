"""Keys, constraint checks, profiles."""

from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.hashing import bucket_hash
from millrace.operators import checks, groups, stats

from .fixtures import DOCS, FOLD, H, documents, table

PRIOR_SQL = f"prior AS (SELECT DISTINCT strong FROM docs WHERE part IN ('dev', 'test') UNION SELECT regexp_replace({FOLD}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g') FROM benchmark)"


def prior(spark, sf_dir):
    held = documents(spark, sf_dir).where("part <> 'train'").select("strong")
    bench = table(spark, sf_dir, "benchmark").select(keys.key_strong(F.col("text")).alias("strong"))
    return groups.prior_keys([held, bench], "strong")


def leakage_free(spark, sf_dir):
    return groups.leakage_free(documents(spark, sf_dir), prior(spark, sf_dir).where("strong <> ''"), "strong", "doc_id", "source")


LEAKAGE_FREE = f"""WITH {DOCS}, {PRIOR_SQL}
SELECT min(doc_id) AS id, sha256(strong) AS group_sha256, count(*) AS n_members, count(DISTINCT source) > 1 AS is_conflict
FROM docs WHERE strong <> '' AND strong NOT IN (SELECT strong FROM prior WHERE strong IS NOT NULL) GROUP BY strong"""


def _key(name):
    return lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", F.col(name).alias("key"))


def model_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.model_text(F.col("text")).alias("model_text"))


def group_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2("strong", 256).alias("group_sha256"))


def partition_profile(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_labels"), F.count_if(F.trim("text") == "").alias("n_blank"), F.sum(F.length("text")).alias("n_chars"))


def partition_counts(spark, sf_dir):
    return checks.count_mismatch(documents(spark, sf_dir), "part", {"train": 800, "dev": 100, "test": 100, "other": 1})


def label_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def dup_keys(spark, sf_dir):
    return checks.dup_keys(documents(spark, sf_dir).select(F.sha2("strong", 256).alias("group_sha256")), "group_sha256")


def key_mismatch(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return checks.key_mismatch(d.select("doc_id"), lab.select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 10_000_000).otherwise(0)).alias("doc_id")), "doc_id")


def split_leakage(spark, sf_dir):
    return checks.split_leakage(documents(spark, sf_dir), "strong", "part")


def reserved_overlap(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.sha2("strong", 256).alias("group_sha256"), "part", "source")
    return checks.reserved_overlap({"v2": d.where("part = 'dev'"), "v3": d.where("part = 'test'"), "v4": d.where("source in ('src1', 'src2')")}, "group_sha256")


def unseen_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pair = d.select(F.concat_ws("/", "source", "lang").alias("label"), (bucket_hash("part", "doc_id") % 10 == 1).alias("dev"))
    return checks.not_subset(pair.where("dev"), pair.where("not dev"), "label").unionByName(
        table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label")).distinct().where("label like '1%' or label like '5%'")
    )


def stale_group_hash(spark, sf_dir):
    d = documents(spark, sf_dir)
    stored = F.when(bucket_hash("stale", "doc_id") % 20 == 0, F.sha2("weak", 256)).otherwise(F.sha2("strong", 256))
    return checks.stale_hash(d.withColumn("group_sha256", stored), F.col("strong"), "group_sha256").select("doc_id", "group_sha256")


def prior_keys(spark, sf_dir):
    return prior(spark, sf_dir).select(F.sha2("strong", 256).alias("group_sha256"))


def reserved_resolution(spark, sf_dir):
    d = documents(spark, sf_dir)
    fake = bucket_hash("fake", "doc_id") % 7 == 0
    hashes = d.where("part = 'dev'").select(F.when(fake, F.sha2(F.concat(F.lit("gone"), "strong"), 256)).otherwise(F.sha2("strong", 256)).alias("group_sha256"))
    return checks.reserved_resolution(hashes, d, "strong")


def length_filter(spark, sf_dir, most: int = 1800):
    return table(spark, sf_dir, "documents").where(F.length("text") <= most).select("doc_id", F.length("text").cast("long").alias("n"))


def length_summary(spark, sf_dir):
    """Minimum, median, maximum and the 0.9 order statistic at the half-even index, by language."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("n"))
    p90 = stats.order_statistic(d, ["lang"], "n", lambda n: F.bround(0.9 * (n - 1)).cast("long"), "p90_n")
    return d.groupBy("lang").agg(F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n")).join(p90, "lang")


def multiset_ops(spark, sf_dir):
    """Words of two languages' documents as multisets: sizes of the intersection and both differences, by partition.

    Counts are taken first, so a frequent word is one row."""
    d = documents(spark, sf_dir)
    w = d.where("lang in ('en', 'fr')").select("part", "lang", F.explode(F.split("text", " ")).alias("word"))
    n = w.groupBy("part", "word").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "fr").alias("b"))
    return n.groupBy("part").agg(F.sum(F.least("a", "b")).alias("n_both"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_only_a"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("n_only_b"))


HASH = "sha256(strong)"
QUERIES = {
    "leakage_free": (leakage_free, LEAKAGE_FREE),
    "key_weak": (_key("weak"), f"WITH {DOCS} SELECT doc_id, weak AS key FROM docs"),
    "key_strong": (_key("strong"), f"WITH {DOCS} SELECT doc_id, strong AS key FROM docs"),
    "key_alnum": (_key("alnum"), f"WITH {DOCS} SELECT doc_id, alnum AS key FROM docs"),
    "model_text": (model_text, f"SELECT doc_id, regexp_replace(regexp_replace({FOLD}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS model_text FROM documents"),
    "group_hash": (group_hash, f"WITH {DOCS} SELECT doc_id, {HASH} AS group_sha256 FROM docs"),
    "partition_profile": (partition_profile, f"WITH {DOCS} SELECT part, count(*) AS n, count(DISTINCT lang) AS n_labels, count(*) FILTER (trim(text) = '') AS n_blank, sum(length(text))::BIGINT AS n_chars FROM docs GROUP BY part"),
    "partition_counts": (
        partition_counts,
        f"""WITH {DOCS}, want(part, expected) AS (VALUES ('train', 800), ('dev', 100), ('test', 100), ('other', 1)), have AS (SELECT part, count(*) AS n FROM docs GROUP BY part)
        SELECT part, coalesce(expected, 0)::BIGINT AS expected, coalesce(n, 0) AS n FROM want FULL JOIN have USING (part) WHERE coalesce(expected, 0) <> coalesce(n, 0)""",
    ),
    "label_counts": (label_counts, "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL"),
    "dup_keys": (dup_keys, f"WITH {DOCS} SELECT {HASH} AS group_sha256, count(*) AS n FROM docs GROUP BY ALL HAVING n > 1"),
    "key_mismatch": (
        key_mismatch,
        """WITH l AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 10000000 ELSE 0 END AS doc_id FROM labels)
        SELECT (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS n_missing, (SELECT count(DISTINCT doc_id) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_extra""",
    ),
    "split_leakage": (
        split_leakage,
        f"WITH {DOCS}, k AS (SELECT DISTINCT strong, part FROM docs) SELECT a.part AS split_a, b.part AS split_b, count(*) AS n_keys FROM k a JOIN k b ON a.strong = b.strong AND a.part < b.part GROUP BY ALL",
    ),
    "reserved_overlap": (
        reserved_overlap,
        f"""WITH {DOCS}, k AS (SELECT DISTINCT {HASH} AS group_sha256, 'v2' AS tag FROM docs WHERE part = 'dev' UNION ALL SELECT DISTINCT {HASH}, 'v3' FROM docs WHERE part = 'test'
        UNION ALL SELECT DISTINCT {HASH}, 'v4' FROM docs WHERE source IN ('src1', 'src2')) SELECT group_sha256, count(*) AS n_sets FROM k GROUP BY ALL HAVING n_sets > 1""",
    ),
    "unseen_labels": (
        unseen_labels,
        f"""WITH p AS (SELECT source || '/' || lang AS label, {H("part", "doc_id")} % 10 = 1 AS dev FROM documents)
        SELECT DISTINCT label FROM p WHERE dev AND label NOT IN (SELECT label FROM p WHERE NOT dev) UNION ALL SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%'""",
    ),
    "stale_group_hash": (
        stale_group_hash,
        f"WITH {DOCS} SELECT doc_id, g AS group_sha256 FROM (SELECT *, CASE WHEN {H('stale', 'doc_id')} % 20 = 0 THEN sha256(weak) ELSE {HASH} END AS g FROM docs) WHERE g <> {HASH}",
    ),
    "prior_keys": (prior_keys, f"WITH {DOCS}, {PRIOR_SQL} SELECT {HASH} AS group_sha256 FROM prior"),
    "reserved_resolution": (
        reserved_resolution,
        f"""WITH {DOCS}, h AS (SELECT DISTINCT CASE WHEN {H("fake", "doc_id")} % 7 = 0 THEN sha256('gone' || strong) ELSE {HASH} END AS g FROM docs WHERE part = 'dev'), k AS (SELECT {HASH} AS g FROM docs)
        SELECT count(*) FILTER (g IN (SELECT g FROM k)) AS n_resolved, count(*) FILTER (g NOT IN (SELECT g FROM k)) AS n_unresolved FROM h""",
    ),
    "length_filter": (length_filter, "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) <= 1800"),
    "length_summary": (
        length_summary,
        "SELECT lang, v[1] AS min_n, m AS median_n, v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS p90_n, v[-1] AS max_n FROM (SELECT lang, list_sort(list(length(text)::BIGINT)) AS v, median(length(text))::DOUBLE AS m FROM documents GROUP BY lang)",
    ),
    "multiset_ops": (
        multiset_ops,
        f"""WITH {DOCS}, w AS (SELECT part, lang, unnest(string_split(text, ' ')) AS word FROM docs WHERE lang IN ('en', 'fr')), n AS (SELECT part, word, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM w GROUP BY ALL)
        SELECT part, sum(least(a, b))::BIGINT AS n_both, sum(greatest(a - b, 0))::BIGINT AS n_only_a, sum(greatest(b - a, 0))::BIGINT AS n_only_b FROM n GROUP BY part""",
    ),
}
