"""Deterministic draws: rank by hash, take the first ones.

Draws by bucket use a window over the bucket with a bound on its rank, which Spark applies before the
shuffle; global draws use ORDER BY with LIMIT. Draws that depend on earlier ones are settled in rounds of joins.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.tables import ONE_TASK, numbered, written

from .checks import ConstraintError
from .stats import order_statistics


def topk_per_bucket(df: DataFrame, bucket: Sequence[str], order: Sequence[Column | str], k: int | Column) -> DataFrame:
    """The first k rows of each bucket, with their rank ``rn`` from 1."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)).cast("long")).where(F.col("rn") <= k)


def natural_holdout(df: DataFrame, rank: str, key: str, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """Slices of the given sizes off the rows in rank order, with ``split`` and ``ord``; labels play no part.

    Only the rows that some slice takes are numbered, in ranges where they are many."""
    total = sum(n for _, n in sizes)
    # LIMIT gathers what it keeps in one task, so it is for few rows alone
    taken = df.orderBy(rank, key).limit(total) if total <= ONE_TASK else _first(df.withColumn("_step", F.lit(0)), {0: total}, rank, key).drop("_step")
    placed = numbered(taken, (), (rank, key), "ord", total)
    split, upto = F.lit(None).cast("string"), 0
    for name, n in sizes:
        split = F.when((F.col("ord") > upto) & (F.col("ord") <= upto + n), name).otherwise(split)
        upto += n
    return placed.withColumn("split", split)


def _first(rows: DataFrame, quotas: dict[int, int], rank: str, key: str) -> DataFrame:
    """Of each step (column _step) the first rows by rank and key, as many as its quota.

    Small quotas take a bounded window. For large ones the rank of the last row taken is found by counting (the first 15
    hex digits of the rank, as a number); only rows that share these digits with it are put in order."""
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col("_step")).cast("long")
    order = Window.partitionBy("_step").orderBy(rank, key)
    if max(quotas.values()) <= ONE_TASK:
        return rows.withColumn("_rn", F.row_number().over(order)).where((F.col("_rn") <= max(quotas.values())) & (F.col("_rn") <= quota)).drop("_rn")
    digits = F.conv(F.substring(rank, 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("_digits", digits)
    step = F.col("_step")
    limits = {q: [i for i, k in quotas.items() if k == q] for q in set(quotas.values())}
    last = None
    for q, steps in limits.items():
        got = order_statistics(rows.where(step.isin(*steps)), ["_step"], "_digits", lambda n, q=q: [F.least(n, F.lit(q)) - 1])
        got = got.select(F.col("_group._step").alias("_step"), F.element_at("vals", 1).alias("_last"))
        last = got if last is None else last.unionByName(got)
    last = F.broadcast(written(last))  # a row for each step
    marked = rows.join(last, "_step")
    below = marked.where("_digits < _last")
    held = below.groupBy("_step").agg(F.count(F.lit(1)).alias("_below"))
    even = marked.where("_digits = _last").join(F.broadcast(held), "_step", "left")
    even = even.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") + F.coalesce("_below", F.lit(0)) <= quota)
    return below.drop("_digits", "_last").unionByName(even.drop("_digits", "_last", "_below", "_rn"))


def settle(candidates: DataFrame, quotas: dict[int, int], rank: str = "rank", key: str = "key") -> DataFrame:
    """candidates(_step, rank, key) -> those that the steps take, where each step in turn takes its first keys, as many as its
    quota, of those that no step before it has taken.

    By deferred acceptance: all steps at once propose to the keys at the head of their lists; a key keeps the earliest step that
    has proposed and is struck off the lists of all later ones. Rounds end when no key has two proposals, and as a
    key's step can only become an earlier one, the outcome is that of taking turns. Candidates are written once; what a
    round adds is a table of the keys proposed to."""
    many = sum(quotas.values()) > ONE_TASK
    lists = written(candidates)
    struck = None
    while True:
        left = lists if struck is None else lists.join(struck, key, "left").where(F.col("_held").isNull() | (F.col("_step") <= F.col("_held"))).drop("_held")
        proposed = written(_first(left, quotas, rank, key))
        held = proposed.groupBy(key).agg(F.min("_step").alias("_held"), F.count(F.lit(1)).alias("_n"))
        if not held.where("_n > 1").limit(1).count():
            return proposed
        held = held.drop("_n")
        struck = written(held) if many else F.broadcast(written(held))  # at most as many rows as all quotas


def quota_sample(candidates: DataFrame, steps: Sequence[tuple[str, str, int]], key: str = "key") -> DataFrame:
    """candidates(split, bucket, rank, key) -> (split, bucket, key, ord): each step (split, bucket, quota) takes the first keys
    that no step before it has taken.

    A key may be a candidate of several buckets, so the steps depend on each other. A step looks at no more than the sum of
    all quotas rows of its bucket; these are settled in rounds, and no task holds them all."""
    total = sum(q for *_, q in steps)
    quotas = {i: q for i, (*_, q) in enumerate(steps)}
    names = candidates.sparkSession.createDataFrame([(s, b, i) for i, (s, b, _) in enumerate(steps)], "split string, bucket string, _step int")
    rows = candidates.select("split", "bucket", "rank", F.col(key).alias("key"))
    if total <= ONE_TASK:
        rows = topk_per_bucket(rows, ["split", "bucket"], ["rank", "key"], total).drop("rn")
    taken = settle(rows.join(F.broadcast(names), ["split", "bucket"]), quotas)  # a row for each step
    return numbered(taken, ["_step"], ["rank", "key"], "ord", total).select("split", "bucket", "key", "ord")


def unique_take(df: DataFrame, label: str, key: str, rank: str, k: int, labels: int) -> DataFrame:
    """Of each label, in label order, the first k rows whose key no label has used; ``labels``: how many labels there are at most."""
    found = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().limit(labels + 1).collect())
    if len(found) > labels:
        raise ConstraintError(f"more than {labels} labels")
    once = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), F.col(rank).alias("_rank")).groupBy("_label", "_key").agg(F.min("_rank").alias("_rank"))
    if not found:
        return once.select(F.col("_label").alias(label), F.col("_key").alias(key), F.col("_rank").alias(rank))
    place = F.create_map(*[x for i, name in enumerate(found) for x in (F.lit(name), F.lit(i))])
    rows = once.where(F.col("_label").isNotNull()).withColumn("_step", F.element_at(place, F.col("_label")))
    if k * labels <= ONE_TASK:
        rows = topk_per_bucket(rows, ["_label"], ["_rank", "_key"], k * labels).drop("rn")
    taken = settle(rows, dict.fromkeys(range(len(found)), k), "_rank", "_key")
    return taken.select(F.col("_label").alias(label), F.col("_key").alias(key), F.col("_rank").alias(rank))


def balanced_sample(df: DataFrame, label: str, rank: str, key: str, k: int) -> DataFrame:
    """k rows of each label, or all it has."""
    return topk_per_bucket(df, [label], [rank, key], k)


def stratified_subset(df: DataFrame, label: str, rank: str, key: str, limit: int) -> DataFrame:
    """Rows taken in turn from the labels, in label order, until ``limit`` is reached."""
    return topk_per_bucket(df, [label], [rank, key], limit).orderBy("rn", label).limit(limit)


def probe_rows(df: DataFrame, group: str, order: str) -> DataFrame:
    """First, middle and last row of each group."""
    w = Window.partitionBy(group)
    numbered = df.withColumn("rn", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    return numbered.where("rn = 1 or rn = _n or rn = floor(_n / 2) + 1").drop("_n")


def shortfall(df: DataFrame, labels: DataFrame, label: str, quota: int) -> DataFrame:
    """Labels with fewer rows than the quota, those without rows included."""
    have = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return labels.select(label).distinct().join(have, label, "left").select(label, F.coalesce("n", F.lit(0).cast("long")).alias("n")).where(F.col("n") < quota)


def shuffle_take(df: DataFrame, key: str, seed: str, n: int, strict: bool = False) -> DataFrame:
    """n rows in a seeded order, with ``ord`` from 1; of rows with equal keys the last by content counts. Too few raise if strict."""
    once = df.groupBy(key).agg(F.max(F.struct(*[c for c in df.columns if c != key])).alias("_r")).select(key, "_r.*")
    taken = once.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n)
    out = taken.withColumn("ord", F.row_number().over(Window.orderBy("_h", key)).cast("long")).drop("_h")  # n rows
    if strict and out.count() < n:
        raise ConstraintError(f"fewer than {n} rows")
    return out


def prefix(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)
