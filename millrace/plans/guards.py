"""Guards of an evaluation, on gold rows and predictions that are spoilt by hash; small operators without a place elsewhere."""

from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.hashing import bucket_hash
from millrace.functions.spans import TARGET_TYPES
from millrace.operators import checks, datasets, evaluation, gates, groups, locks, metrics, sampling, stats

from . import classification, entities, trees
from .fixtures import DOCS, FOLD, UTTS, H, class_predictions, documents, predictions_sql, table, utterances

FILE = "e" * 64


def _gold(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.sha2("strong", 256).alias("group_sha256"))


def _records(spark, sf_dir):
    """Prediction records: some are absent, twice there, extra, or of another group or file, or without output."""
    h = bucket_hash("spoil", "doc_id") % 40
    p = class_predictions(documents(spark, sf_dir)).select("doc_id", "raw_output").join(documents(spark, sf_dir).select("doc_id", "strong"), "doc_id").withColumn("h", h).where("h <> 0")
    times = F.when(F.col("h") == 1, F.array(F.lit(""), F.lit(""))).when(F.col("h") == 2, F.array(F.lit(""), F.lit("x"))).otherwise(F.array(F.lit("")))
    p = p.select("*", F.explode(times).alias("mark"))
    return p.select(
        F.concat("mark", F.col("doc_id").cast("string")).alias("id"), F.when(F.col("h") == 3, F.lit("0" * 64)).when(F.col("h") == 4, F.lit(None)).otherwise(F.sha2("strong", 256)).alias("group_sha256"),
        F.when(F.col("h") == 5, F.lit("f" * 64)).otherwise(F.lit(FILE)).alias("eval_file_sha256"), F.when(F.col("h") == 6, F.lit(None)).otherwise(F.col("raw_output")).alias("raw_output"),
    )


def alignment_violations(spark, sf_dir):
    return evaluation.alignment_violations(_gold(spark, sf_dir), _records(spark, sf_dir), FILE)


def _spoilt_gold(spark, sf_dir):
    h = bucket_hash("gold", "id") % 40
    s = F.col("slots")
    change = lambda kind=None, value=None: F.transform(s, lambda x: F.struct((kind if kind is not None else x["type"]).alias("type"), (value(x) if value else x["value"]).alias("value")))
    slots = F.when(h == 0, F.lit(None)).when(h == 1, change(kind=F.lit("song_name"))).when(h == 2, change(value=lambda x: F.lit(""))).when(h == 3, change(value=lambda x: F.concat(x["value"], F.lit("☃")))).otherwise(s)
    return utterances(spark, sf_dir).select("id", F.when(h == 4, F.lit(None)).otherwise(F.col("utt")).alias("utt"), slots.alias("slots"))


def gold_violations(spark, sf_dir):
    return evaluation.gold_violations(_spoilt_gold(spark, sf_dir), "id", "utt", "slots")


def entity_macro(spark, sf_dir):
    return evaluation.macro_f1(metrics.entity_prf_by_type(entities.rows(spark, sf_dir)))


def eligible_confidence(spark, sf_dir):
    """A confidence for valid outputs with slots alone: minus their length, as a stand-in for a model."""
    p = entities.parsed(spark, sf_dir)
    scored = evaluation.with_confidence(p, "id", "p", lambda rows: rows.select("id", (-F.length("raw_output")).cast("double").alias("mean_logprob")))
    return scored.select("id", "mean_logprob")


def hybrid_replacements(spark, sf_dir):
    from millrace.operators import ml

    p = entities.parsed(spark, sf_dir).withColumn("lp", -(bucket_hash("lp", "id") % 20).cast("double") / 100)
    return evaluation.replacements(ml.choose_hybrid(p.withColumn("old", F.lit("")), "old", "raw_output", "p", "lp"))


def position_join(spark, sf_dir):
    """Rows of two tables with explicit positions, joined by them."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), "doc_id", "lang")
    return evaluation.align_by_position(d, d.select("ord", "doc_id", F.upper("lang").alias("code")), key="doc_id").select("ord", "lang", "right_code")


def order_mismatch(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("pos"), "strong")
    other = d.where("pos % 17 <> 0").select("pos", F.when(F.col("pos") % 13 == 0, F.lit("?")).otherwise(F.col("strong")).alias("strong"))
    return checks.order_mismatch(d, other, "pos", "strong").select("pos", F.col("right_key").isNull().alias("absent"))


def hex_digests(spark, sf_dir):
    digest = F.when(F.col("doc_id") % 7 == 0, F.upper(F.sha2("strong", 256))).when(F.col("doc_id") % 7 == 1, F.substring(F.sha2("strong", 256), 1, 63)).when(F.col("doc_id") % 7 == 2, F.lit(None)).otherwise(F.sha2("strong", 256))
    d = documents(spark, sf_dir).select("doc_id", digest.alias("digest"))
    return d.select("doc_id", checks.hex_digest("digest").alias("lower_hex"), checks.hex_digest("digest", True).alias("any_hex"))


def improvement_gate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 2).alias("delta"), F.round(F.get("embedding", F.lit(1)).cast("double"), 2).alias("delta_low"))
    return e.select("vec_id", gates.improvement_gate().alias("passed"))


def last_wins(spark, sf_dir):
    return groups.last_wins(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


def latest_checkpoint(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.concat(F.lit("run/checkpoint-"), F.col("doc_id").cast("string")).alias("path"))
    return gates.latest(c, "path")


def group_members(spark, sf_dir):
    m = groups.members(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return m.select("conv_id", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["turn"], r["role"])), " ").alias("members"))


def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 19 == 0, 429).when(F.col("event_id") % 23 == 0, 400).otherwise(200).cast("long").alias("status"))
    return stats.throughput(e, "status", 63.5)


def shuffle_take(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sampling.shuffle_take(c, "conv_id", "42", 100)


def prefix_rows(spark, sf_dir):
    return sampling.prefix(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 25)


def report_cross(spark, sf_dir):
    """Two reports of the sources; the second lacks one and gives another a wrong figure."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("doc_id").cast("double").alias("last"))
    first = F.substring(F.md5("source"), 1, 1)
    other = d.where(first != "0").withColumn("n", F.when(first.isin("1", "2"), F.col("n") + 1e-6).otherwise(F.col("n")))
    return gates.cross_check(d, other, "source", "n", "last")


def token_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.transform(F.split("text", " "), F.length)).alias("nested"))
    return c.select("conv_id", "turn", F.array_join(datasets.token_ids(F.col("nested")), " ").alias("ids"))


def metric_projection(spark, sf_dir):
    """The figures that a comparison shows, without the private ones."""
    from millrace.sinks.jsonl import aggregates_only, public_columns

    score = classification.clf_score(spark, sf_dir).withColumn("_cells", F.lit(1))
    return aggregates_only(public_columns(score).select("n", "n_classes", "accuracy", "macro_f1"))


def read_back_violations(spark, sf_dir):
    """An earlier training set with ids that the source lacks, texts that have changed and rows that repeat."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "strong")
    h = bucket_hash("old", "id") % 30
    old = d.where("id % 3 = 0").select(F.when(h == 0, F.concat(F.lit("y"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string")).alias("id"), F.when(h == 1, F.lit("changed")).otherwise(F.col("strong")).alias("strong"), F.explode(F.when(h == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_"))
    return locks.read_back_violations(old, d, "strong")


def prior_assets(spark, sf_dir):
    """Keys of two earlier sets that the source confirms, with the sizes that they must have."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "strong")
    a, b = d.where("id % 4 = 0"), d.where("id % 6 = 0")
    every, counts = locks.prior_assets(d, {"first": a, "second": b}, {"first": a.count(), "second": b.count()}, "strong")
    return counts.unionByName(every.agg(F.lit("all").alias("asset"), F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("n_groups")))


def partition_violations(spark, sf_dir):
    from millrace.sources.archive import partition_violations as found

    d = documents(spark, sf_dir).select((F.col("doc_id") % 150).alias("id"), F.col("part").alias("partition"))
    return found(d, {"train": 1, "dev": 2, "test": 3, "other": 0})


def overlap_entity_sensitivity(spark, sf_dir):
    """Entity F1 over training utterances, and over those whose key no held-out one has, from one reading of the outputs."""
    u = utterances(spark, sf_dir).select("id", "part", F.sha2(keys.key_strong(F.col("utt")), 256).alias("h"))
    seen = u.where("part <> 'train'").select("h", F.lit(True).alias("seen")).distinct()
    flags = u.where("part = 'train'").join(seen, "h", "left").select("id", F.coalesce("seen", F.lit(False)).alias("seen"))
    cells = metrics.entity_cells(entities.rows(spark, sf_dir).join(flags, "id"), F.col("seen"))
    full, free = (metrics.prf_of_cells(c).select(F.col("micro_f1").alias(n)) for c, n in ((cells, "full_f1"), (cells.where("not seen"), "disjoint_f1")))
    both = full.crossJoin(free)  # one row each
    return both.select(F.round("full_f1", 9).alias("full_f1"), F.round("disjoint_f1", 9).alias("disjoint_f1"), F.round(F.col("disjoint_f1") - F.col("full_f1"), 9).alias("delta"))


def chat_splits(spark, sf_dir):
    from millrace.operators import tree

    return tree.chat_splits(trees.sft_chains(spark, sf_dir), "message_id", "42", 40, 10, strict=False).select("message_id", "split", "ord")


_SPOIL = f"{H('spoil', 'doc_id')} % 40"
ALIGN = f"""WITH {DOCS}, {predictions_sql()}, gold AS (SELECT doc_id::VARCHAR AS id, sha256(strong) AS g FROM docs),
rec AS (SELECT mark || doc_id AS id, CASE h WHEN 3 THEN repeat('0', 64) WHEN 4 THEN NULL ELSE sha256(strong) END AS g, CASE h WHEN 5 THEN 'f' ELSE 'e' END AS f, CASE h WHEN 6 THEN NULL ELSE raw_output END AS raw
  FROM (SELECT *, unnest(CASE h WHEN 1 THEN ['', ''] WHEN 2 THEN ['', 'x'] ELSE [''] END) AS mark FROM (SELECT p.doc_id, p.raw_output, d.strong, {_SPOIL.replace('doc_id', 'p.doc_id')} AS h FROM preds p JOIN docs d USING (doc_id)) WHERE h <> 0)),
gs AS (SELECT id, count(*) AS n, min(g) AS lo, max(g) AS hi FROM gold GROUP BY id), ps AS (SELECT id, count(*) AS n, min(g) AS lo, max(g) AS hi, count(*) FILTER (f <> 'e') AS foreign_, count(*) FILTER (raw IS NULL) AS blank FROM rec GROUP BY id),
j AS (SELECT coalesce(gs.id, ps.id) AS id, coalesce(gs.n, 0) AS ng, coalesce(ps.n, 0) AS np, gs.lo AS gl, gs.hi AS gh, ps.lo AS pl, ps.hi AS ph, foreign_, blank FROM gs FULL JOIN ps USING (id))
""" + " UNION ALL ".join(f"SELECT id, '{k}' AS violation FROM j WHERE {t}" for k, t in {
    "duplicate_gold": "ng > 1", "duplicate_prediction": "np > 1", "missing_prediction": "np = 0", "extra_prediction": "ng = 0", "foreign_group": "ng > 0 AND np > 0 AND (gl IS DISTINCT FROM pl OR gh IS DISTINCT FROM ph)", "foreign_file": "foreign_ > 0", "missing_output": "blank > 0",
}.items())
_KNOWN = "['" + "', '".join(TARGET_TYPES) + "']"
GOLD = f"""WITH {UTTS}, g AS (SELECT id, CASE h WHEN 4 THEN NULL ELSE utt END AS utt, CASE h WHEN 0 THEN NULL WHEN 1 THEN list_transform(slots, lambda s: {{'type': 'song_name', 'value': s.value}}) WHEN 2 THEN list_transform(slots, lambda s: {{'type': s.type, 'value': ''}})
  WHEN 3 THEN list_transform(slots, lambda s: {{'type': s.type, 'value': s.value || '☃'}}) ELSE slots END AS slots FROM (SELECT *, {H('gold', 'id')} % 40 AS h FROM utts))
""" + " UNION ALL ".join(f"SELECT id, '{k}' AS violation FROM g WHERE {t}" for k, t in {
    "no_utterance": "utt IS NULL", "no_slots": "slots IS NULL", "unknown_type": f"len(list_filter(slots, lambda s: NOT list_contains({_KNOWN}, s.type))) > 0", "blank_value": "len(list_filter(slots, lambda s: s.value = '')) > 0",
    "not_in_utterance": "len(list_filter(slots, lambda s: NOT coalesce(contains(utt, s.value), false))) > 0",
}.items())

QUERIES = {
    "alignment_violations": (alignment_violations, ALIGN),
    "gold_violations": (gold_violations, GOLD),
    "entity_macro": (entity_macro, f"SELECT round(avg(coalesce(f1, 0)), 9) AS macro_f1, count(*) AS n_types FROM ({entities.QUERIES['entity_prf_by_type'][1]})"),
    "eligible_confidence": (eligible_confidence, f"WITH {entities.PARSED} SELECT id, CASE WHEN error IS NULL AND len(pred) > 0 THEN -length(raw_output)::DOUBLE END AS mean_logprob FROM parsed"),
    "hybrid_replacements": (hybrid_replacements, f"WITH {entities.PARSED} SELECT count(*) AS n, count(*) FILTER (error IS NULL AND len(pred) > 0 AND {H('lp', 'id')} % 20 <= 8) AS n_replaced FROM parsed"),
    "overlap_entity_sensitivity": (
        overlap_entity_sensitivity,
        f"{entities.ENT}, kk AS (SELECT id, part, regexp_replace({FOLD.replace('text', 'utt')}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g') AS strong FROM utts), tr AS (SELECT id, strong IN (SELECT strong FROM kk WHERE part <> 'train') AS seen FROM kk WHERE part = 'train') "
        f"SELECT round(a.micro_f1, 9) AS full_f1, round(b.micro_f1, 9) AS disjoint_f1, round(b.micro_f1 - a.micro_f1, 9) AS delta FROM ({entities.PRF.format(where='WHERE id IN (SELECT id FROM tr)')}) a CROSS JOIN ({entities.PRF.format(where='WHERE id IN (SELECT id FROM tr WHERE NOT seen)')}) b",
    ),
    "chat_splits": (
        chat_splits,
        f"SELECT message_id, CASE WHEN ord <= 40 THEN 'train' ELSE 'held_out' END AS split, ord FROM (SELECT message_id, row_number() OVER (ORDER BY sha256('42|' || message_id), message_id) AS ord FROM ({trees.QUERIES['sft_chains'][1]})) WHERE ord <= 50",
    ),
    "position_join": (position_join, "SELECT doc_id AS ord, lang, upper(lang) AS right_code FROM documents"),
    "order_mismatch": (order_mismatch, "SELECT doc_id AS pos, doc_id % 17 = 0 AS absent FROM documents WHERE doc_id % 17 = 0 OR doc_id % 13 = 0"),
    "hex_digests": (hex_digests, "SELECT doc_id, doc_id % 7 > 2 AS lower_hex, doc_id % 7 > 2 OR doc_id % 7 = 0 AS any_hex FROM documents"),
    "improvement_gate": (improvement_gate, "SELECT vec_id, round(embedding[1]::DOUBLE, 2) >= 0.02::DOUBLE AND round(embedding[2]::DOUBLE, 2) > 0 AS passed FROM embeddings"),
    "last_wins": (last_wins, "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source"),
    "latest_checkpoint": (latest_checkpoint, "SELECT 'run/checkpoint-' || max(doc_id) AS path FROM documents"),
    "group_members": (group_members, "SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn, role) AS members FROM conversations GROUP BY conv_id"),
    "throughput": (throughput, "WITH s AS (SELECT CASE WHEN event_id % 19 = 0 THEN 429 WHEN event_id % 23 = 0 THEN 400 ELSE 200 END::BIGINT AS status FROM events) SELECT status, count(*) AS n, count(*) / (SELECT count(*) FROM s) AS share, round_even((SELECT count(*) FROM s) / 63.5::DOUBLE, 2) AS per_second FROM s GROUP BY status"),
    "shuffle_take": (shuffle_take, "SELECT conv_id, turn, row_number() OVER (ORDER BY sha256('42|' || conv_id), conv_id) AS ord FROM (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) ORDER BY ord LIMIT 100"),
    "prefix_rows": (prefix_rows, "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25"),
    "report_cross": (report_cross, "WITH d AS (SELECT DISTINCT source, substr(md5(source), 1, 1) AS c FROM documents) SELECT source, 'n' AS value, c NOT IN ('0', '1', '2') AS passed FROM d UNION ALL SELECT source, 'last', c <> '0' FROM d"),
    "token_ids": (token_ids, "SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda x: length(x)), ' ') AS ids FROM conversations"),
    "metric_projection": (metric_projection, f"SELECT n, n_classes, accuracy, macro_f1 FROM ({classification.QUERIES['clf_score'][1]})"),
    "read_back_violations": (read_back_violations, f"SELECT CASE h WHEN 0 THEN 'y' || doc_id ELSE doc_id::VARCHAR END AS id, CASE h WHEN 0 THEN 'absent' WHEN 1 THEN 'other_key' ELSE 'duplicate_id' END AS violation FROM (SELECT doc_id, {H('old', 'doc_id')} % 30 AS h FROM documents WHERE doc_id % 3 = 0) WHERE h <= 2"),
    "prior_assets": (prior_assets, f"WITH {DOCS} SELECT 'first' AS asset, count(*) AS n, count(DISTINCT strong) AS n_groups FROM docs WHERE doc_id % 4 = 0 UNION ALL SELECT 'second', count(*), count(DISTINCT strong) FROM docs WHERE doc_id % 6 = 0 UNION ALL SELECT 'all', 0, count(DISTINCT strong) FROM docs WHERE doc_id % 4 = 0 OR doc_id % 6 = 0"),
    "partition_violations": (
        partition_violations,
        f"WITH {DOCS}, s AS (SELECT doc_id % 150 AS id, part FROM docs), i AS (SELECT id, count(*) AS n, count(DISTINCT part) AS p FROM s GROUP BY id), w AS (SELECT 'size of ' || part AS what, count(s.part) AS n, any_value(e) AS e FROM (VALUES ('train', 1), ('dev', 2), ('test', 3)) x(part, e) LEFT JOIN s USING (part) GROUP BY part) "
        "SELECT what, n FROM w WHERE n <> e UNION ALL SELECT * FROM (SELECT 'repeated ids', count(*) FILTER (n > 1 AND p = 1) AS n FROM i UNION ALL SELECT 'shared ids', count(*) FILTER (p > 1) FROM i) WHERE n > 0",
    ),
}
