"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn, adjacent turns of one role
are merged into a block, and the blocks are concatenated:

    <s>[ROLE]role[/ROLE]text[TURN]text</s>

``[TURN]`` separates the texts that were merged, so the turns can be read back. In roles and
texts ``\\``, ``<`` and ``[`` are written ``\\0``, ``\\1`` and ``\\2``: no control string of this
or another template (``</s>``, ``[INST]``, ``<|...|>``) survives inside a text, and reading
undoes it. The loss mask is an array of spans (start from 0, length, in code points) over the
formatted text, one for each turn of the trained role, without separators and markers.

A conversation is one output value, so its turns must meet; nothing else is gathered.

Defined cases: null text and null role are empty; equal turn numbers are ordered by role,
then text; repeated rows are turns of their own; rows with null conv_id form one
conversation; null turns come first; extra columns are ignored. Other orders of the input
give the same output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, ROLE_END, BETWEEN, CLOSE = "<s>[ROLE]", "[/ROLE]", "[TURN]", "</s>"
#: Written in this order, read back in the opposite one.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, trained_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask array<struct<start, length>>."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # each turn opens a block or goes on with the one before it, and closes it or not
    n = F.size("turns")
    merged = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            escape(t["text"]).alias("body"),
            F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(BETWEEN)).otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))).alias("head"),
            F.when((i + 1 < n) & (F.get("turns", i + 1)["role"] == t["role"]), F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
        ),
    )
    parts = whole.select("conv_id", merged.alias("parts"))
    formatted = F.array_join(F.flatten(F.transform("parts", lambda p: F.array(p["head"], p["body"], p["tail"]))), "")
    # running positions: a fold over the parts keeps the place reached and the spans so far
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))
    fold = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long").alias("at"),
            F.when(
                p["role"] == trained_role,
                F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return parts.select("conv_id", formatted.alias("formatted"), fold.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"\Q" + OPEN + r"\E", -1), lambda b, i: i > 0)
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring(b, F.instr(b, ROLE_END) + len(ROLE_END), F.length(b) - F.instr(b, ROLE_END) - len(ROLE_END) - len(CLOSE) + 1), r"\Q" + BETWEEN + r"\E", -1),
            lambda x: F.struct(unescape(F.substring(b, F.lit(1), F.instr(b, ROLE_END) - 1)).alias("role"), unescape(x).alias("text")),
        ),
    )
    return F.flatten(turns)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    done = format_conversations(turns.unionByName(more)).select("*", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS goes_on,
         length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS body,
         length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) AS head
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE WHEN goes_on THEN length('[TURN]') ELSE length('<s>[ROLE][/ROLE]</s>') + head END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
