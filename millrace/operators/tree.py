"""Message trees: ancestor chains and preference pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import strip

from .sampling import shuffle_take

MOST_NODES, MOST_CHARS = 12, 1800


def approved(lang: str = "zh") -> Column:
    """Language, review, deletion, origin and text as wanted; a null fails."""
    yes = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return yes("lang", lang) & yes("review_result", True) & yes("deleted", False) & yes("synthetic", False) & F.coalesce(strip(F.col("text")) != "", F.lit(False))


def chains(messages: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(message_id, path): the nodes from the root to each message, for whole chains of ``most`` nodes at most.

    messages(message_id, parent_id, role, text, ok). The path is array<struct<node, role, n_chars, ok>>; texts are fetched by
    ``with_texts`` for the chains that are left. A chain with a missing parent
    has no row. Paths double in length with every join, so a dozen nodes take four joins and not twelve.
    """
    step = messages.select("message_id", F.col("parent_id").alias("top"), F.array(F.struct(F.col("message_id").alias("node"), "role", F.length(strip(F.col("text"))).alias("n_chars"), "ok")).alias("path"))
    reach = 1
    while reach < most:
        up = step.select(F.col("message_id").alias("top"), F.col("top").alias("_next"), F.col("path").alias("_above"))
        # rows that have reached their root don't join and stay; rows whose parent is missing drop out below
        joined = step.join(up, "top", "left")
        step = joined.where("top is null or _above is not null").select(
            "message_id", F.when(F.col("top").isNull(), F.lit(None)).otherwise(F.col("_next")).alias("top"), F.when(F.col("top").isNull(), F.col("path")).otherwise(F.concat("_above", "path")).alias("path")
        )
        reach *= 2
    return step.where(F.col("top").isNull() & (F.size("path") <= most)).select("message_id", "path")


def with_texts(found: DataFrame, messages: DataFrame) -> DataFrame:
    """The chains with paths array<struct<role, text>>, texts without white space around them."""
    nodes = found.select("message_id", F.posexplode("path").alias("pos", "t")).select("message_id", "pos", "t.role", F.col("t.node").alias("node"))
    texts = messages.select(F.col("message_id").alias("node"), strip(F.col("text")).alias("text"))
    path = nodes.join(texts, "node").groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("p"))
    return path.select("message_id", F.transform("p", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("path"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.when(t["role"] == "prompter", F.lit("user")).otherwise(F.lit("assistant")), F.lit(": "), t["text"])), "\n")


def length_of(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0), lambda n, t: n + t["n_chars"])


def sft_chains(messages: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(message_id, n_turns, prompt, completion) of approved first-rank assistant messages whose ancestors are all approved, begin with
    a prompter and end with one, within the bounds."""
    start = messages.where("role = 'assistant' and rank = 0 and ok").select("message_id")
    c = chains(messages).join(start, "message_id", "left_semi")
    path, n = F.col("path"), F.size("path")
    fine = (n >= 2) & F.forall(path, lambda t: t["ok"]) & (F.get(path, F.lit(0))["role"] == "prompter") & (F.get(path, n - 2)["role"] == "prompter")
    short = (length_of(F.slice(path, 1, n - 1)) <= most_chars) & (F.get(path, n - 1)["n_chars"] <= most_chars)
    c = with_texts(c.where(fine).where(short), messages)
    return c.select("message_id", n.cast("long").alias("n_turns"), rendered(F.slice(path, 1, n - 1)).alias("prompt"), F.get(path, n - 1)["text"].alias("completion"))


def preference_pairs(messages: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(parent_id, prompt, chosen, rejected): first- and second-rank replies to an approved prompter, with its chain.

    Of several replies of a rank the one with the smallest id counts. Bounds apply to the text as it is."""
    reply = lambda r: messages.where(f"role = 'assistant' and ok and rank = {r}").groupBy("parent_id").agg(F.min_by("text", "message_id").alias(f"r{r}"))
    parents = messages.where("role = 'prompter' and ok").select(F.col("message_id").alias("parent_id"))
    both = parents.join(reply(0), "parent_id").join(reply(1), "parent_id")
    both = both.where((strip(F.col("r0")) != strip(F.col("r1"))) & (F.length("r0") <= most_chars) & (F.length("r1") <= most_chars))
    path = chains(messages).where(F.forall("path", lambda t: t["ok"]) & (F.get("path", F.lit(0))["role"] == "prompter") & (length_of(F.col("path")) <= most_chars))
    path = with_texts(path.join(both.select(F.col("parent_id").alias("message_id")), "message_id", "left_semi"), messages)
    both = both.join(path.withColumnRenamed("message_id", "parent_id"), "parent_id")
    return both.select("parent_id", rendered(F.col("path")).alias("prompt"), strip(F.col("r0")).alias("chosen"), strip(F.col("r1")).alias("rejected"))


def chat_splits(records: DataFrame, key: str, seed: str, n_train: int, n_held: int, strict: bool = True) -> DataFrame:
    """The records with split and ord: a seeded shuffle, of which the first rows are for training and the next are held out.
    Too few rows raise if strict."""
    taken = shuffle_take(records, key, seed, n_train + n_held, strict)
    return taken.withColumn("split", F.when(F.col("ord") <= n_train, "train").otherwise("held_out"))
