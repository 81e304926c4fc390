"""Builders of training records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import strip
from millrace.functions.spans import TARGET_TYPES, canonical_json
from millrace.operators.checks import guarded

#: The instructions of the two tasks.
SLOT_PROMPT = '从原句抽取 date、time、place_name、person 槽位。只输出 JSON 对象，键为 slots，元素包含 type 和 value；没有目标槽位输出 {"slots":[]}。value 必须逐字复制原句。\n原句：'
INTENT_PROMPT = "判断这条中文语音助理请求的意图。只输出一个意图标签，不要输出解释、标点或其他文字。\n\n请求："
EMPTY = '{"slots":[]}'


def turn(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def sft_records(df: DataFrame, utterance: str, slots: str, *keep: str) -> DataFrame:
    """prompt and completion as arrays of turns."""
    return df.select(*keep, turn("user", F.concat(F.lit(SLOT_PROMPT), utterance)).alias("prompt"), turn("assistant", canonical_json(F.col(slots))).alias("completion"))


def matched_sft(pairs: DataFrame, *keep: str) -> DataFrame:
    """Preference records as plain ones: chosen becomes the completion. Anything but one assistant turn raises."""
    ok = (F.size("chosen") == 1) & (F.get("chosen", F.lit(0))["role"] == "assistant")
    return pairs.select(*keep, "prompt", guarded(ok, F.col("chosen"), "chosen isn't one assistant turn").alias("completion"))


def error_pairs(df: DataFrame, utterance: str, gold: str, pred: str, raw: str, *keep: str) -> DataFrame:
    """Gold answer against a wrong, non-blank output. A null prediction is wrong."""
    wrong = df.where(~F.col(pred).eqNullSafe(F.col(gold)) & (strip(F.col(raw)) != ""))
    return wrong.select(*keep, F.concat(F.lit(INTENT_PROMPT), utterance).alias("prompt"), F.col(gold).alias("chosen"), strip(F.col(raw)).alias("rejected"))


def wrong_literal(utterance: Column) -> Column:
    """The first run of up to three letters or numbers; null if there is none."""
    return F.nullif(F.regexp_extract(utterance, r"[\p{L}\p{N}]{1,3}", 0), F.lit(""))


def fallback_rejected(slots: Column, utterance: Column, digest: Column) -> Column:
    """A wrong answer that is well formed: no slot where there are some, else a literal of a type that the digest picks."""
    pick = F.element_at(F.array(*map(F.lit, TARGET_TYPES)), (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 4 + 1).cast("int"))
    made = F.when(wrong_literal(utterance).isNotNull(), canonical_json(F.array(F.struct(pick.alias("type"), wrong_literal(utterance).alias("value")))))
    return F.when(F.size(slots) > 0, F.lit(EMPTY)).otherwise(made)


def rank_candidates(df: DataFrame, group: str, label: str, logprobs: str) -> DataFrame:
    """Sum and mean of each candidate's log-probabilities and its rank by either; ties go to the smaller label."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x.cast("double"))
    s = df.select(group, label, F.round(total, 6).alias("sum_logprob"), F.round(total / F.size(logprobs), 8).alias("mean_logprob"), F.size(logprobs).cast("long").alias("scored_tokens"))
    by = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), label)).cast("long")
    return s.select("*", by("sum_logprob").alias("rank_sum"), by("mean_logprob").alias("rank_mean"))


def preference_winrate(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """How often the chosen answer is likelier, by sum and mean, and by how much. Equal isn't a win."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    d = df.select((F.round(total(chosen) - total(rejected), 6)).alias("s"), F.round(total(chosen) / F.size(chosen) - total(rejected) / F.size(rejected), 8).alias("m"))
    share = lambda c: F.round(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)), 9)
    return d.agg(F.count(F.lit(1)).alias("n"), share("s").alias("win_sum"), share("m").alias("win_mean"), F.round(F.avg("s"), 6).alias("margin_sum"), F.round(F.avg("m"), 6).alias("margin_mean"))


def blind_assignment(cases: DataFrame, case: str, models: list[str], labels: list[str], seed: str) -> DataFrame:
    """(case, label, model): each case's models under the labels, in an order that the hash of case and model gives."""
    m = cases.select(case, F.explode(F.array(*map(F.lit, models))).alias("model"))
    n = F.row_number().over(Window.partitionBy(case).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), case, "model"), 256), "model"))
    return m.select(case, F.element_at(F.array(*map(F.lit, labels)), n).alias("label"), "model")


def mask_audit(ids: Column, prefix: Column, labels: Column) -> dict[str, Column]:
    """Whether a sequence begins with its prompt, whether the prompt is masked (-100) and whether the rest is learned."""
    n = F.size(prefix)
    return {
        "prefix_ok": F.slice(ids, 1, n) == prefix,
        "mask_ok": F.forall(F.slice(labels, 1, n), lambda x: x == -100),
        "completion_ok": (F.size(ids) > n) & (F.slice(labels, n + 1, F.size(ids)) == F.slice(ids, n + 1, F.size(ids))),
    }


def token_ids(nested: Column) -> Column:
    """One sequence of ids from an array of one sequence; several sequences, or a null id, raise."""
    ok = (F.size(nested) == 1) & F.forall(F.get(nested, F.lit(0)), lambda x: x.isNotNull())
    return guarded(ok, F.flatten(nested), "not one token sequence")
