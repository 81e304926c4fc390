"""Annotated utterances and model outputs: spans, tags, parsing, entity scores, taxonomy."""

from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.functions.hashing import bucket_hash
from millrace.functions.spans import TARGET_TYPES
from millrace.operators import metrics
from millrace.tables import once

from .fixtures import TYPES_SQL, UTTS, H, parsed_sql, raw_outputs, raw_sql, utterances

PARSED = f"{UTTS}, {raw_sql()}, {parsed_sql()}"
TWO = f"{PARSED}, {raw_sql('raws2', 'raw2')}, {parsed_sql('parsed2', 'raws2')}"


def parsed(spark, sf_dir, salt="raw"):
    r = raw_outputs(utterances(spark, sf_dir), salt)
    return spans.with_parsed(r, "raw_output", "utt")


def rows(spark, sf_dir, salt="raw"):
    return metrics.entity_counts(parsed(spark, sf_dir, salt).withColumn("pred", F.col("p.slots")), "slots", "pred", "id", "doc_id")


def _text(slots):
    return F.array_join(F.transform(slots, lambda s: F.concat_ws("=", s["type"], s["value"])), "|")


def text_sql(slots):
    return f"array_to_string(list_transform({slots}, lambda s: s.type || '=' || s.value), '|')"


def aligned(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return once(u, spans=spans.align_annotations("utt", "annot_utt"))


def annotation_spans(spark, sf_dir):
    """Types and values of all marks, natively, and the target slots of the exact aligner."""
    a = aligned(spark, sf_dir)
    return a.select("id", F.array_join(spans.annotation_types(F.col("annot_utt")), "|").alias("types"), F.array_join(spans.annotation_values(F.col("annot_utt")), "|").alias("vals"), _text(F.col("spans")).alias("slots"))


def align_gold(spark, sf_dir):
    """Utterances whose slots, derived anew, aren't the stored ones."""
    a = aligned(spark, sf_dir)
    stored = F.when(bucket_hash("stale", "id") % 25 == 0, F.slice("slots", 2, 9)).otherwise(F.col("slots"))
    new = F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value")))
    return a.where(stored != new).select("id", _text(stored).alias("stored"), _text(new).alias("derived"))


def bio_tags(spark, sf_dir):
    a = aligned(spark, sf_dir)
    return a.select("id", F.array_join(spans.bio_tags(F.col("utt"), F.col("spans")), " ").alias("tags"))


#: Tags made from the slots' words: a word's place is after the words before it.
BIO_SQL = f"""SELECT u.id, array_to_string(list_transform(range(1, length(u.utt) + 1), lambda i: CASE WHEN i = sa + 1 THEN 'B-' || ka WHEN i > sa AND i <= sa + la THEN 'I-' || ka WHEN i = sb + 1 THEN 'B-' || kb WHEN i > sb AND i <= sb + lb THEN 'I-' || kb ELSE 'O' END), ' ') AS tags FROM
(SELECT id, utt, CASE WHEN marked AND t <> 2 THEN length(array_to_string(w[:a - 1], ' ')) + CASE WHEN a > 1 THEN 1 ELSE 0 END ELSE -9 END AS sa, CASE WHEN marked AND t <> 2 THEN length(w[a]) ELSE 0 END AS la, ta AS ka,
  CASE WHEN both_ THEN length(array_to_string(w[:b - 1], ' ')) + CASE WHEN b > 1 THEN 1 ELSE 0 END ELSE -9 END AS sb, CASE WHEN both_ THEN length(w[b]) ELSE 0 END AS lb, tb AS kb FROM utt_marks) u"""


def bio_to_slots(spark, sf_dir):
    a = aligned(spark, sf_dir)
    tags = spans.bio_tags(F.col("utt"), F.col("spans"))
    # every third utterance loses its B- tags: isolated I- tags begin slots
    tags = F.when(bucket_hash("bio", "id") % 3 == 0, F.transform(tags, lambda t: F.regexp_replace(t, "^B-", "I-"))).otherwise(tags)
    a = a.select("id", "utt", tags.alias("tags"))
    return spans.slots_from_bio(a, "id", "utt", "tags").select("id", _text(F.col("slots")).alias("slots"))


def char_features(spark, sf_dir):
    """How often each contextual feature value of a character occurs, over the characters of all utterances.

    Equal surroundings are counted first; features are made of the distinct ones."""
    edge = F.lit(spans.BOUNDARY)
    u = utterances(spark, sf_dir).select("utt").mapInArrow(spans.count_windows, spans.WINDOWS).groupBy(*"abcde").agg(F.sum("n").alias("n"))
    x = F.col("c")
    gram = lambda *names: F.when(F.forall(F.array(*names), lambda v: v != edge), F.concat(*names))
    values = {"digit": x.rlike("^[0-9]$").cast("string"), "space": x.rlike(r"^[\p{IsWhite_Space}]$").cast("string"), "latin": x.rlike("^[A-Za-z]$").cast("string"), "first": (F.col("b") == edge).cast("string"), "last": (F.col("d") == edge).cast("string")}
    values |= {f"c{d:+d}": F.col(name) for d, name in zip((-2, -1, 0, 1, 2), "abcde")}
    values |= {"gram-2:+0": gram("a", "b", "c"), "gram-1:+0": gram("b", "c"), "gram+0:+1": gram("c", "d"), "gram+0:+2": gram("c", "d", "e"), "gram-1:+1": gram("b", "c", "d")}
    f = u.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])).alias("f")).select("f.*", "n")
    return f.where("value is not null").groupBy("feature", "value").agg(F.sum("n").alias("n"))


def _features_sql():
    at = lambda d: f"CASE WHEN i + {d} >= 1 AND i + {d} <= length(utt) THEN substr(utt, i + {d}, 1) ELSE '<BOUNDARY>' END"
    gram = lambda a, b: f"CASE WHEN i + {a} >= 1 AND i + {b} <= length(utt) THEN substr(utt, i + {a}, {b - a + 1}) END"
    values = {"digit": "regexp_full_match(c, '[0-9]')::VARCHAR", "space": "regexp_full_match(c, '[\\s\\p{Z}]')::VARCHAR", "latin": "regexp_full_match(c, '[A-Za-z]')::VARCHAR", "first": "(i = 1)::VARCHAR", "last": "(i = length(utt))::VARCHAR"}
    values |= {f"c{d:+d}": at(d) for d in (-2, -1, 0, 1, 2)} | {f"gram{a:+d}:{b:+d}": gram(a, b) for a, b in ((-2, 0), (-1, 0), (0, 1), (0, 2), (-1, 1))}
    each = " UNION ALL ".join(f"SELECT '{k}' AS feature, {v} AS value, count(*) AS n FROM chars GROUP BY ALL" for k, v in values.items())
    return f"WITH {UTTS}, chars AS (SELECT utt, i, substr(utt, i, 1) AS c FROM (SELECT utt, unnest(range(1, length(utt) + 1)) AS i FROM utts)) SELECT * FROM ({each}) WHERE value IS NOT NULL"


def canonical_json(spark, sf_dir):
    return utterances(spark, sf_dir).select("id", spans.canonical_json(F.col("slots")).alias("json"))


def parse_outputs(spark, sf_dir):
    return parsed(spark, sf_dir).select("id", "p.json_valid", "p.schema_valid", "p.copy_valid", "p.error", _text(F.col("p.slots")).alias("slots"))


def span_type_counts(spark, sf_dir):
    u = utterances(spark, sf_dir).select("part", F.explode("slots").alias("s")).groupBy("part", "s.type").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(p, t) for p in ("train", "dev", "test") for t in (*TARGET_TYPES, "person_title")], "part string, type string")
    return every.join(u, ["part", "type"], "left").select("part", "type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def entity_prf(spark, sf_dir):
    return metrics.entity_prf(rows(spark, sf_dir))


def entity_prf_by_type(spark, sf_dir):
    return metrics.entity_prf_by_type(rows(spark, sf_dir))


def entity_prf_positive(spark, sf_dir):
    return metrics.entity_prf(rows(spark, sf_dir).where("n_gold > 0"))


def entity_validity(spark, sf_dir):
    p = parsed(spark, sf_dir)
    t = p.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"p.{c}").alias(f"n_{c}") for c in ("json_valid", "schema_valid", "copy_valid")])
    return t.select("*", *[metrics.ratio(f"n_{c}", "n").alias(f"{c}_rate") for c in ("json_valid", "schema_valid", "copy_valid")])


def no_slot_failure(spark, sf_dir):
    t = metrics.entity_prf(rows(spark, sf_dir))
    return t.select("n_no_slot", "n_no_slot_fp", "n_no_slot_invalid", metrics.ratio(F.col("n_no_slot_fp") + F.col("n_no_slot_invalid"), "n_no_slot").alias("failure_rate"))


def badcase_taxonomy(spark, sf_dir):
    p = parsed(spark, sf_dir).withColumn("pred", F.col("p.slots"))
    return metrics.taxonomy(metrics.taxonomy_flags(p, "slots", "pred", "p", "id"))


def semantic_error(spark, sf_dir):
    """Outputs that are invalid or whose slots aren't the gold ones as a multiset."""
    return parsed(spark, sf_dir).where(~metrics.same_multiset(F.col("slots"), F.col("p.slots"))).select("id", "raw_output")


def logprob():
    h = bucket_hash("lp", "id") % 1000
    return F.when(bucket_hash("lp0", "id") % 11 == 0, F.lit(None)).when(h % 10 == 0, F.lit(-0.08)).otherwise(-h / F.lit(5000.0)).cast("double")


LP_SQL = f"CASE WHEN {H('lp0', 'id')} % 11 = 0 THEN NULL WHEN {H('lp', 'id')} % 1000 % 10 = 0 THEN -0.08::DOUBLE ELSE -({H('lp', 'id')} % 1000) / 5000.0::DOUBLE END"


def hybrid_choice(spark, sf_dir):
    from millrace.operators.ml import choose_hybrid

    a = parsed(spark, sf_dir, "raw2").select("id", F.col("raw_output").alias("new_raw"), "p", logprob().alias("mean_logprob"))
    b = raw_outputs(utterances(spark, sf_dir)).select("id", F.col("raw_output").alias("old_raw"))
    return choose_hybrid(a.join(b, "id"), "old_raw", "new_raw", "p", "mean_logprob").select("id", "mean_logprob", "chosen", "replaced")


def slot_report(spark, sf_dir):
    """For review: slots or none, whether they may be used; the report itself never acts."""
    p = parsed(spark, sf_dir)
    return p.select("id", F.coalesce(_text(F.col("p.slots")), F.lit("")).alias("slots"), F.col("p.copy_valid").alias("usable"), F.lit(True).alias("abstained"))


COUNTS = """sides AS (SELECT id, doc_id, slots, pred, pred IS NOT NULL AS valid FROM {parsed}),
expl AS (SELECT id, s.type AS type, s.value AS value, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p FROM (SELECT id, unnest(slots) AS s, 1 AS g, 0 AS p FROM sides UNION ALL SELECT id, unnest(pred), 0, 1 FROM sides) GROUP BY ALL),
ent AS (SELECT id, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM expl GROUP BY id),
erows AS (SELECT s.id, s.doc_id, valid, len(slots) AS n_gold, coalesce(len(pred), 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, valid AND coalesce(fp, 0) = 0 AND coalesce(fn, 0) = 0 AS exact FROM sides s LEFT JOIN ent USING (id))"""
PRF = """SELECT n, n_exact, n_invalid, tp, fp, fn, n_no_slot, n_no_slot_fp, n_no_slot_invalid, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS micro_f1, n_exact / n AS exact_rate
FROM (SELECT count(*) AS n, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT valid) AS n_invalid, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (n_gold = 0) AS n_no_slot,
count(*) FILTER (n_gold = 0 AND valid AND n_pred > 0) AS n_no_slot_fp, count(*) FILTER (n_gold = 0 AND NOT valid) AS n_no_slot_invalid FROM erows {where})"""
ENT = f"WITH {PARSED}, {COUNTS.format(parsed='parsed')}"


def _taxonomy_sql():
    pairs = lambda test: f"valid AND id IN (SELECT a.id FROM rest a JOIN rest b ON a.id = b.id WHERE a.g > a.p AND b.p > b.g AND {test})"
    flags = {
        "fully_correct": "exact", "incorrect": "NOT exact", "invalid_json": "NOT json_valid", "invalid_schema": "json_valid AND NOT schema_valid", "invalid_copy": "schema_valid AND NOT copy_valid",
        "missed_all_gold_slots": "n_gold > 0 AND tp = 0", "missed_all_gold_slots_valid_output": "valid AND n_gold > 0 AND tp = 0", "extra_slots_on_gold_empty": "valid AND n_gold = 0 AND n_pred > 0", "partial_correct": "valid AND tp > 0 AND NOT exact",
        "type_confusion_same_value": pairs("a.value = b.value AND a.type <> b.type"), "same_type_different_value": pairs("a.type = b.type AND a.value <> b.value"),
        "possible_span_boundary_mismatch": pairs("a.type = b.type AND a.value <> b.value AND (contains(a.value, b.value) OR contains(b.value, a.value))"),
        "duplicate_slot_output": "valid AND id IN (SELECT id FROM rest WHERE p > 1)", "excess_duplicate_slot": "valid AND id IN (SELECT id FROM rest WHERE p > greatest(1, g))",
    }
    base = {"missed_all_gold_slots": "n_gold > 0", "missed_all_gold_slots_valid_output": "n_gold > 0", "extra_slots_on_gold_empty": "n_gold = 0"}
    each = " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER ({v}) AS n, count(*) FILTER ({base.get(k, 'true')}) AS denominator FROM f" for k, v in flags.items())
    return f"{ENT}, rest AS MATERIALIZED (SELECT * FROM expl), f AS MATERIALIZED (SELECT e.*, p.json_valid, p.schema_valid, p.copy_valid FROM erows e JOIN parsed p USING (id)) SELECT *, n / nullif(denominator, 0) AS rate FROM ({each})"


QUERIES = {
    "annotation_spans": (annotation_spans, f"WITH {UTTS} SELECT id, array_to_string(regexp_extract_all(annot_utt, '\\[\\s*([A-Za-z_]+)\\s*:\\s*([^\\[\\]]+?)\\]', 1), '|') AS types, array_to_string(regexp_extract_all(annot_utt, '\\[\\s*([A-Za-z_]+)\\s*:\\s*([^\\[\\]]+?)\\]', 2), '|') AS vals, {text_sql('slots')} AS slots FROM utts"),
    "align_gold": (align_gold, f"WITH {UTTS}, s AS (SELECT id, slots, CASE WHEN {H('stale', 'id')} % 25 = 0 THEN slots[2:] ELSE slots END AS stored FROM utts) SELECT id, {text_sql('stored')} AS stored, {text_sql('slots')} AS derived FROM s WHERE len(stored) <> len(slots)"),
    "bio_tags": (bio_tags, f"WITH {UTTS} {BIO_SQL}"),
    "bio_to_slots": (bio_to_slots, f"WITH {UTTS} SELECT id, {text_sql('slots')} AS slots FROM utts"),
    "char_features": (char_features, _features_sql()),
    "canonical_json": (canonical_json, f"WITH {UTTS} SELECT id, to_json({{'slots': slots}})::VARCHAR AS json FROM utts"),
    "parse_outputs": (parse_outputs, f"WITH {PARSED} SELECT id, json_valid, schema_valid, copy_valid, error, {text_sql('pred')} AS slots FROM parsed"),
    "span_type_counts": (
        span_type_counts,
        f"WITH {UTTS}, n AS (SELECT part, s.type AS type, count(*) AS n FROM (SELECT part, unnest(slots) AS s FROM utts) GROUP BY ALL) SELECT part, type, coalesce(n, 0) AS n FROM (SELECT unnest(['train', 'dev', 'test']) AS part) CROSS JOIN (SELECT unnest({TYPES_SQL} || ['person_title']) AS type) LEFT JOIN n USING (part, type)",
    ),
    "entity_prf": (entity_prf, f"{ENT} {PRF.format(where='')}"),
    "entity_prf_by_type": (
        entity_prf_by_type,
        f"""{ENT}, t AS (SELECT type, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM expl GROUP BY type)
        SELECT type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (SELECT unnest({TYPES_SQL}) AS type) LEFT JOIN t USING (type)""",
    ),
    "entity_prf_positive": (entity_prf_positive, f"{ENT} {PRF.format(where='WHERE n_gold > 0')}"),
    "entity_validity": (entity_validity, f"WITH {PARSED} SELECT n, n_json_valid, n_schema_valid, n_copy_valid, n_json_valid / n AS json_valid_rate, n_schema_valid / n AS schema_valid_rate, n_copy_valid / n AS copy_valid_rate FROM (SELECT count(*) AS n, count(*) FILTER (json_valid) AS n_json_valid, count(*) FILTER (schema_valid) AS n_schema_valid, count(*) FILTER (copy_valid) AS n_copy_valid FROM parsed)"),
    "no_slot_failure": (no_slot_failure, f"{ENT} SELECT n_no_slot, n_no_slot_fp, n_no_slot_invalid, coalesce((n_no_slot_fp + n_no_slot_invalid) / nullif(n_no_slot, 0), 0)::DOUBLE AS failure_rate FROM ({PRF.format(where='')})"),
    "badcase_taxonomy": (badcase_taxonomy, _taxonomy_sql()),
    "semantic_error": (semantic_error, f"{ENT} SELECT id, raw_output FROM parsed WHERE id IN (SELECT id FROM erows WHERE NOT exact)"),
    "hybrid_choice": (
        hybrid_choice,
        f"WITH {TWO}, b AS (SELECT p.id, r.raw_output AS old_raw, p.raw_output AS new_raw, p.pred, {LP_SQL.replace('id)', 'p.id)')} AS mean_logprob FROM parsed2 p JOIN raws r USING (id)) SELECT id, mean_logprob, CASE WHEN coalesce(len(pred), 0) > 0 AND coalesce(mean_logprob >= -0.08::DOUBLE, false) THEN new_raw ELSE old_raw END AS chosen, coalesce(len(pred), 0) > 0 AND coalesce(mean_logprob >= -0.08::DOUBLE, false) AS replaced FROM b",
    ),
    "slot_report": (slot_report, f"WITH {PARSED} SELECT id, coalesce({text_sql('pred')}, '') AS slots, copy_valid AS usable, true AS abstained FROM parsed"),
}
