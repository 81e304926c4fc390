"""Message trees, preference pairs, training records."""

from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.hashing import bucket_hash
from millrace.operators import datasets, metrics, tree

from . import entities, sampling
from .classification import PREDS, normalised
from .fixtures import FOLD, TYPES_SQL, UTTS, H, documents, table, utterances


def messages(spark, sf_dir):
    """Conversations as trees: a turn's parent is the one before it; another conversation's reply is the second-ranked one."""
    c = table(spark, sf_dir, "conversations")
    mid = F.concat_ws("-", "conv_id", "turn")
    role = F.when(F.col("role") == "user", "prompter").otherwise(F.col("role"))
    parent = F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1))
    first = c.select(mid.alias("message_id"), parent.alias("parent_id"), role.alias("role"), "text", F.lit(0).alias("rank"))
    other = c.where("role = 'assistant'").select((F.col("conv_id") - 1).alias("conv_id"), "turn", "text")
    second = c.where("role = 'assistant'").select("conv_id", "turn").join(other, ["conv_id", "turn"]).select(F.concat(mid, F.lit("-r")).alias("message_id"), parent.alias("parent_id"), F.lit("assistant").alias("role"), "text", F.lit(1).alias("rank"))
    m = first.unionByName(second)
    h = lambda s: bucket_hash(s, "message_id")
    m = m.select(
        "*", F.when(h("ml") % 20 == 0, "en").otherwise("zh").alias("lang"), F.when(h("rv") % 25 == 0, F.lit(None)).otherwise(h("rv") % 25 != 1).alias("review_result"),
        F.when(h("dl") % 25 == 0, F.lit(None)).otherwise(h("dl") % 25 == 1).alias("deleted"), (h("sy") % 25 == 0).alias("synthetic"),
    )
    return m.withColumn("ok", tree.approved())


SPACES = "E' \\t\\n\\x0b\\x0c\\r'"
MESSAGES = f"""first AS (SELECT conv_id || '-' || turn AS message_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_id, CASE role WHEN 'user' THEN 'prompter' ELSE role END AS role, text, 0 AS rank FROM conversations),
second AS (SELECT c.conv_id || '-' || c.turn || '-r' AS message_id, CASE WHEN c.turn > 0 THEN c.conv_id || '-' || (c.turn - 1) END AS parent_id, 'assistant' AS role, o.text, 1 AS rank FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id + 1 AND o.turn = c.turn AND o.role = 'assistant' WHERE c.role = 'assistant'),
marked AS (SELECT *, CASE WHEN {H("ml", "message_id")} % 20 = 0 THEN 'en' ELSE 'zh' END AS lang, CASE {H("rv", "message_id")} % 25 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS review_result, CASE {H("dl", "message_id")} % 25 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS deleted,
  {H("sy", "message_id")} % 25 = 0 AS synthetic FROM (SELECT * FROM first UNION ALL SELECT * FROM second)),
msg AS (SELECT *, coalesce(lang = 'zh' AND review_result AND NOT deleted AND NOT synthetic AND trim(text, {SPACES}) <> '', false) AS ok FROM marked),
walk(id, node, parent_id, n, all_ok, chars, txt, root) AS (SELECT message_id, message_id, parent_id, 1, ok, 0, '', role FROM msg UNION ALL
  SELECT w.id, m.message_id, m.parent_id, w.n + 1, w.all_ok AND m.ok, w.chars + length(trim(m.text, {SPACES})), CASE WHEN m.role = 'prompter' THEN 'user' ELSE 'assistant' END || ': ' || trim(m.text, {SPACES}) || CASE WHEN w.txt = '' THEN '' ELSE chr(10) || w.txt END, m.role FROM walk w JOIN msg m ON m.message_id = w.parent_id WHERE w.n < 12),
chain AS (SELECT * FROM walk WHERE parent_id IS NULL)"""


def approved_messages(spark, sf_dir):
    return messages(spark, sf_dir).where("ok").select("message_id", "role", "rank")


def sft_chains(spark, sf_dir):
    return tree.sft_chains(messages(spark, sf_dir))


def preference_pairs(spark, sf_dir):
    return tree.preference_pairs(messages(spark, sf_dir))


def sft_records(spark, sf_dir):
    r = datasets.sft_records(utterances(spark, sf_dir), "utt", "slots", "id")
    return r.select("id", F.to_json("prompt").alias("prompt"), F.to_json("completion").alias("completion"))


def _pairs(spark, sf_dir):
    u = entities.parsed(spark, sf_dir)
    wrong = ~metrics.same_multiset(F.col("slots"), F.col("p.slots"))
    digest = F.sha2(keys.key_strong(F.col("utt")), 256)
    rejected = F.when(wrong, F.col("raw_output")).otherwise(datasets.fallback_rejected(F.col("slots"), F.col("utt"), digest))
    from millrace.functions.spans import canonical_json

    return u.select("id", datasets.turn("user", F.concat(F.lit(datasets.SLOT_PROMPT), "utt")).alias("prompt"), datasets.turn("assistant", canonical_json(F.col("slots"))).alias("chosen"), rejected.alias("rejected"), wrong.alias("is_model_error"))


def matched_sft(spark, sf_dir):
    m = datasets.matched_sft(_pairs(spark, sf_dir), "id")
    return m.select("id", F.to_json("prompt").alias("prompt"), F.to_json("completion").alias("completion"))


def error_pairs(spark, sf_dir):
    d = documents(spark, sf_dir).where("part = 'train'").select("doc_id", "text")
    p = normalised(spark, sf_dir).select("doc_id", "gold", "prediction", "raw_output")
    return datasets.error_pairs(d.join(p, "doc_id"), "text", "gold", "prediction", "raw_output", "doc_id")


def fallback_rejected(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "rejected", "is_model_error")


def _logprobs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"))


def preference_winrate(spark, sf_dir):
    e = _logprobs(spark, sf_dir)
    a = e.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("k"), F.col("lp").alias("a"))
    b = e.where("vec_id % 2 = 1").select(F.expr("(vec_id - 1) div 2").alias("k"), F.slice("lp", 1, 48).alias("b"))
    return datasets.preference_winrate(a.join(b, "k"), "a", "b")


def candidate_ranking(spark, sf_dir):
    e = _logprobs(spark, sf_dir).select("label", "vec_id", F.expr("slice(lp, 1, cast(vec_id % 60 as int) + 4)").alias("lp"))
    return datasets.rank_candidates(e, "label", "vec_id", "lp")


def source_id_overlap(spark, sf_dir):
    """Message ids that a manifest of splits and a flat list share, by split."""
    m = messages(spark, sf_dir).where("rank = 0").select("message_id")
    h = bucket_hash("manifest", "message_id")
    nested = m.where(h % 3 == 0).groupBy(F.when(h % 2 == 0, "sft").otherwise("dpo").alias("split")).agg(F.collect_set("message_id").alias("ids"))
    flat = m.where(h % 4 == 0)
    ids = nested.select("split", F.explode("ids").alias("message_id"))
    return ids.join(flat, "message_id").groupBy("split").agg(F.count_distinct("message_id").alias("n"))


def render_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat(F.lit("### "), t["role"], F.lit("\n\n"), t["text"])), "\n\n").alias("markdown"))


def blind_assignment(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct()
    return datasets.blind_assignment(c, "case_id", ["base", "sft", "dpo"], ["A", "B", "C"], "blind")


def mask_audit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.length("text") % 17 + 1).alias("n"))
    h = bucket_hash("mask", "id") % 6
    ids = F.sequence(F.lit(1), F.col("n") + 5)
    prefix = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: F.when((h == 0) & (x == 1), F.lit(99)).otherwise(x))
    labels = F.transform(ids, lambda x: F.when((x <= F.col("n")) & ~((h == 1) & (x == F.col("n"))), F.lit(-100)).when((h == 2) & (x == F.col("n") + 5), F.lit(-100)).otherwise(x))
    return c.select("id", *[v.alias(k) for k, v in datasets.mask_audit(ids, prefix, labels).items()])


_SLOT_PROMPT = datasets.SLOT_PROMPT.replace("\n", "' || chr(10) || '")
_INTENT_PROMPT = datasets.INTENT_PROMPT.replace("\n", "' || chr(10) || '")
_USER = f"to_json([{{'role': 'user', 'content': '{_SLOT_PROMPT}' || utt}}])::VARCHAR"
_SAID = "to_json([{'role': 'assistant', 'content': to_json({'slots': slots})::VARCHAR}])::VARCHAR"
_DIGEST = f"sha256(regexp_replace({FOLD.replace('text', 'utt')}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g'))"
_LITERAL = "regexp_extract(utt, '[\\p{L}\\p{N}]{1,3}')"
_LP = "lp AS (SELECT vec_id, label, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS lp FROM embeddings)"
_SUM = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda a, x: a + x)"

QUERIES = {
    "approved_messages": (approved_messages, f"WITH RECURSIVE {MESSAGES} SELECT message_id, role, rank FROM msg WHERE ok"),
    "sft_chains": (
        sft_chains,
        f"WITH RECURSIVE {MESSAGES} SELECT c.id AS message_id, c.n::BIGINT AS n_turns, c.txt AS prompt, trim(m.text, {SPACES}) AS completion FROM chain c JOIN msg m ON m.message_id = c.id JOIN msg p ON p.message_id = m.parent_id WHERE m.role = 'assistant' AND m.rank = 0 AND c.all_ok AND c.root = 'prompter' AND p.role = 'prompter' AND c.n >= 2 AND c.chars <= 1800 AND length(trim(m.text, {SPACES})) <= 1800",
    ),
    "preference_pairs": (
        preference_pairs,
        f"""WITH RECURSIVE {MESSAGES}, r AS (SELECT parent_id, arg_min(text, message_id) FILTER (rank = 0) AS r0, arg_min(text, message_id) FILTER (rank = 1) AS r1 FROM msg WHERE role = 'assistant' AND ok GROUP BY parent_id)
        SELECT m.message_id AS parent_id, c.txt || CASE WHEN c.txt = '' THEN '' ELSE chr(10) END || 'user: ' || trim(m.text, {SPACES}) AS prompt, trim(r0, {SPACES}) AS chosen, trim(r1, {SPACES}) AS rejected FROM msg m JOIN chain c ON c.id = m.message_id JOIN r ON r.parent_id = m.message_id
        WHERE m.role = 'prompter' AND m.ok AND c.all_ok AND c.root = 'prompter' AND c.chars + length(trim(m.text, {SPACES})) <= 1800 AND trim(r0, {SPACES}) <> trim(r1, {SPACES}) AND length(r0) <= 1800 AND length(r1) <= 1800""",
    ),
    "sft_records": (sft_records, f"WITH {UTTS} SELECT id, {_USER} AS prompt, {_SAID} AS completion FROM utts"),
    "matched_sft": (matched_sft, f"WITH {UTTS} SELECT id, {_USER} AS prompt, {_SAID} AS completion FROM utts"),
    "error_pairs": (error_pairs, f"WITH {PREDS} SELECT n.doc_id, '{_INTENT_PROMPT}' || text AS prompt, gold AS chosen, trim(raw_output, {SPACES}) AS rejected FROM norm n JOIN docs USING (doc_id) WHERE n.part = 'train' AND prediction IS DISTINCT FROM gold AND trim(raw_output, {SPACES}) <> ''"),
    "fallback_rejected": (
        fallback_rejected,
        f"""{entities.ENT}, w AS (SELECT p.*, NOT e.exact AS wrong FROM parsed p JOIN erows e USING (id)) SELECT id, CASE WHEN wrong THEN raw_output WHEN len(slots) > 0 THEN '{datasets.EMPTY}' WHEN {_LITERAL} <> '' THEN
        to_json({{'slots': [{{'type': {TYPES_SQL}[('0x' || substr({_DIGEST}, 1, 8))::BIGINT % 4 + 1], 'value': {_LITERAL}}}]}})::VARCHAR END AS rejected, wrong AS is_model_error FROM w""",
    ),
    "preference_winrate": (
        preference_winrate,
        f"""WITH {_LP}, d AS (SELECT round({_SUM.format('a.lp')} - {_SUM.format('b.lp[:48]')}, 6) AS s, round({_SUM.format('a.lp')} / len(a.lp) - {_SUM.format('b.lp[:48]')} / len(b.lp[:48]), 8) AS m FROM lp a JOIN lp b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)
        SELECT count(*) AS n, round(avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS win_sum, round(avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS win_mean, round(avg(s), 6) AS margin_sum, round(avg(m), 6) AS margin_mean FROM d""",
    ),
    "candidate_ranking": (
        candidate_ranking,
        f"""WITH {_LP}, c AS (SELECT label, vec_id, lp[:vec_id % 60 + 4] AS lp FROM lp), s AS (SELECT label, vec_id, round({_SUM.format('lp')}, 6) AS sum_logprob, round({_SUM.format('lp')} / len(lp), 8) AS mean_logprob, len(lp)::BIGINT AS scored_tokens FROM c)
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY sum_logprob DESC, vec_id) AS rank_sum, row_number() OVER (PARTITION BY label ORDER BY mean_logprob DESC, vec_id) AS rank_mean FROM s""",
    ),
    "source_id_overlap": (source_id_overlap, f"WITH RECURSIVE {MESSAGES}, h AS (SELECT {H('manifest', 'message_id')} AS h FROM msg WHERE rank = 0) SELECT CASE WHEN h % 2 = 0 THEN 'sft' ELSE 'dpo' END AS split, count(*) AS n FROM h WHERE h % 3 = 0 AND h % 4 = 0 GROUP BY ALL"),
    "render_turns": (render_turns, "SELECT conv_id, string_agg('### ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id"),
    "blind_assignment": (blind_assignment, "SELECT case_id, ['A', 'B', 'C'][row_number() OVER (PARTITION BY case_id ORDER BY sha256('blind|' || case_id || '|' || model), model)] AS label, model FROM (SELECT DISTINCT conv_id AS case_id FROM conversations) CROSS JOIN (SELECT unnest(['base', 'sft', 'dpo']) AS model)"),
    "mask_audit": (mask_audit, f"SELECT id, h <> 0 AS prefix_ok, h <> 1 AS mask_ok, h <> 2 AS completion_ok FROM (SELECT id, {H('mask', 'id')} % 6 AS h FROM (SELECT conv_id || '-' || turn AS id FROM conversations))"),
}
