"""Predictions of classes: alignment, scores, overlap."""

from pyspark.sql import functions as F

from millrace.functions.hashing import bucket_hash
from millrace.operators import checks, groups, metrics

from .fixtures import DOCS, LABELS, H, class_predictions, documents, predictions_sql, table

PREDS = f"{DOCS}, {predictions_sql()}, norm AS (SELECT *, CASE WHEN coalesce(given, trim(raw_output, E' \\n')) IN ('de', 'en', 'es', 'fr') THEN coalesce(given, trim(raw_output, E' \\n')) END AS prediction FROM preds)"
#: Scores keep unknown labels apart, so there the outputs aren't cut down to the labels.
OPEN = f"{DOCS}, {predictions_sql()}, norm AS (SELECT *, nullif(coalesce(given, trim(raw_output, E' \\n')), '') AS prediction FROM preds)"


def normalised(spark, sf_dir, salt="pred"):
    return metrics.normalise(class_predictions(documents(spark, sf_dir), salt), list(LABELS), "given", "raw_output")


def open_predictions(spark, sf_dir):
    return class_predictions(documents(spark, sf_dir)).withColumn("prediction", F.nullif(F.coalesce("given", F.trim(F.translate("raw_output", "\n", ""))), F.lit("")))


def prediction_normalise(spark, sf_dir):
    return normalised(spark, sf_dir).select("doc_id", "prediction")


def align_predictions(spark, sf_dir):
    """Two systems' predictions on one gold set: equal ids, one row each."""
    gold = documents(spark, sf_dir).select("doc_id", F.sha2("strong", 256).alias("group_sha256"))
    a, b = (normalised(spark, sf_dir, s).select("doc_id", F.col("prediction").alias(s)) for s in ("pred", "pred2"))
    return gold.join(a, "doc_id").join(b, "doc_id")


def subset_join(spark, sf_dir):
    p = normalised(spark, sf_dir).where("part <> 'train'")
    return documents(spark, sf_dir).join(p.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


def _counts(spark, sf_dir):
    return metrics.confusion(open_predictions(spark, sf_dir), "gold", "prediction")


def clf_score(spark, sf_dir):
    return metrics.classification_score(_counts(spark, sf_dir))


def clf_per_class(spark, sf_dir):
    return metrics.per_class(_counts(spark, sf_dir))


def clf_per_scenario(spark, sf_dir):
    p = open_predictions(spark, sf_dir)
    return p.groupBy(F.col("source").alias("scenario")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("prediction")).alias("n_correct")).withColumn("accuracy", metrics.ratio("n_correct", "n"))


def clf_confusion(spark, sf_dir):
    return metrics.errors_of(_counts(spark, sf_dir))


def duplicate_audit(spark, sf_dir):
    """Texts that a held-out partition shares with training ones: distinct texts and rows, exactly and by key."""
    d = documents(spark, sf_dir)
    out = []
    for name, column in (("exact", "text"), ("alnum", "alnum")):
        train = d.where("part = 'train'").select(F.sha2(column, 256).alias("k")).distinct()
        held = d.where("part <> 'train'").select("part", F.sha2(column, 256).alias("k"))
        hit = held.join(train.withColumn("in", F.lit(True)), "k", "left")
        out.append(hit.groupBy("part").agg(F.count_distinct("k").alias("n_texts"), F.count_distinct(F.when(F.col("in"), F.col("k"))).alias("n_shared_texts"), F.count_if("in").alias("n_shared_rows")).withColumn("kind", F.lit(name)))
    return out[0].unionByName(out[1])


def _overlap(spark, sf_dir):
    d = documents(spark, sf_dir)
    rows = d.where("part = 'train'").join(normalised(spark, sf_dir).select("doc_id", "prediction"), "doc_id")
    return metrics.overlap_flags(rows, "strong", {p: d.where(f"part = '{p}'") for p in ("dev", "test")})


def overlap_audit(spark, sf_dir):
    r = _overlap(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("dev").alias("n_dev"), F.count_if("test").alias("n_test"), F.count_if(F.expr("dev and test")).alias("n_both"), F.count_if(F.expr("dev or test")).alias("n_either"), F.count_if(F.expr("not (dev or test)")).alias("n_disjoint"))


def overlap_sensitivity(spark, sf_dir):
    """Accuracy over all rows and over those without overlap, in one pass."""
    r = _overlap(spark, sf_dir).select((F.col("lang") == F.col("prediction")).alias("hit"), (~(F.col("dev") | F.col("test"))).alias("free"))
    t = r.agg(F.count(F.lit(1)).alias("n_full"), F.count_if("hit").alias("hit_full"), F.count_if("free").alias("n_free"), F.count_if(F.expr("free and hit")).alias("hit_free"))
    return t.select("n_full", "n_free", metrics.ratio("hit_full", "n_full").alias("full"), metrics.ratio("hit_free", "n_free").alias("disjoint")).withColumn("delta", F.col("disjoint") - F.col("full"))


PER_CLASS = """support AS (SELECT gold, count(*) AS support, count(*) FILTER (gold = prediction) AS tp FROM norm GROUP BY gold), predicted AS (SELECT prediction AS gold, count(*) AS predicted FROM norm GROUP BY ALL),
per_class AS (SELECT gold, support, tp, coalesce(predicted, 0) AS predicted, coalesce(tp / nullif(coalesce(predicted, 0), 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall,
    coalesce(2 * tp / nullif(support + coalesce(predicted, 0), 0), 0)::DOUBLE AS f1 FROM support LEFT JOIN predicted USING (gold))"""
OVERLAP = f"""WITH {PREDS}, r AS (SELECT d.doc_id, coalesce(d.lang = n.prediction, false) AS hit, d.strong IN (SELECT strong FROM docs WHERE part = 'dev') AS dev, d.strong IN (SELECT strong FROM docs WHERE part = 'test') AS test FROM docs d JOIN norm n USING (doc_id) WHERE d.part = 'train')"""

QUERIES = {
    "prediction_normalise": (prediction_normalise, f"WITH {PREDS} SELECT doc_id, prediction FROM norm"),
    "align_predictions": (
        align_predictions,
        f"WITH {PREDS}, {predictions_sql('preds2', 'pred2')} SELECT d.doc_id, sha256(strong) AS group_sha256, n.prediction AS pred, CASE WHEN coalesce(p.given, trim(p.raw_output, E' \\n')) IN ('de', 'en', 'es', 'fr') THEN coalesce(p.given, trim(p.raw_output, E' \\n')) END AS pred2 FROM docs d JOIN norm n USING (doc_id) JOIN preds2 p USING (doc_id)",
    ),
    "subset_join": (subset_join, f"WITH {DOCS} SELECT doc_id, lang FROM docs WHERE part <> 'train'"),
    "clf_score": (
        clf_score,
        f"""WITH {OPEN}, {PER_CLASS} SELECT count(*) AS n, count(*) FILTER (gold = prediction) AS n_correct, count(*) FILTER (prediction IN (SELECT gold FROM support)) AS n_valid, count(*) FILTER (prediction NOT IN (SELECT gold FROM support)) AS n_unknown,
        count(*) FILTER (prediction IS NULL) AS n_invalid, (SELECT round(avg(f1), 9) FROM per_class) AS macro_f1, (SELECT count(*) FROM per_class) AS n_classes, (count(*) FILTER (gold = prediction) / count(*))::DOUBLE AS accuracy FROM norm""",
    ),
    "clf_per_class": (clf_per_class, f"WITH {OPEN}, {PER_CLASS} SELECT * FROM per_class"),
    "clf_per_scenario": (clf_per_scenario, f"WITH {OPEN} SELECT source AS scenario, count(*) AS n, count(*) FILTER (gold = prediction) AS n_correct, count(*) FILTER (gold = prediction) / count(*) AS accuracy FROM norm GROUP BY source"),
    "clf_confusion": (clf_confusion, f"WITH {OPEN} SELECT gold, coalesce(prediction, '<INVALID>') AS pred, count(*) AS n FROM norm WHERE gold IS DISTINCT FROM prediction GROUP BY ALL"),
    "duplicate_audit": (
        duplicate_audit,
        f"WITH {DOCS}, k AS (SELECT part, 'exact' AS kind, sha256(text) AS k FROM docs UNION ALL SELECT part, 'alnum', sha256(alnum) FROM docs), t AS (SELECT DISTINCT kind, k, true AS hit FROM k WHERE part = 'train') SELECT part, count(DISTINCT k) AS n_texts, count(DISTINCT k) FILTER (hit) AS n_shared_texts, count(*) FILTER (hit) AS n_shared_rows, kind FROM k LEFT JOIN t USING (kind, k) WHERE part <> 'train' GROUP BY part, kind",
    ),
    "overlap_audit": (overlap_audit, f"{OVERLAP} SELECT count(*) AS n, count(*) FILTER (dev) AS n_dev, count(*) FILTER (test) AS n_test, count(*) FILTER (dev AND test) AS n_both, count(*) FILTER (dev OR test) AS n_either, count(*) FILTER (NOT (dev OR test)) AS n_disjoint FROM r"),
    "overlap_sensitivity": (
        overlap_sensitivity,
        f"{OVERLAP} SELECT count(*) AS n_full, count(*) FILTER (NOT (dev OR test)) AS n_free, (count(*) FILTER (hit) / count(*)) AS full, count(*) FILTER (hit AND NOT (dev OR test)) / count(*) FILTER (NOT (dev OR test)) AS disjoint, count(*) FILTER (hit AND NOT (dev OR test)) / count(*) FILTER (NOT (dev OR test)) - count(*) FILTER (hit) / count(*) AS delta FROM r",
    ),
}
