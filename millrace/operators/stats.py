"""Percentiles, order statistics and bootstraps."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import BROADCAST_ROWS, group_of, numbered, written

# --- order statistics --------------------------------------------------------------------
# Distributed selection: values become longs of the same order, and each pass counts the next BITS bits of those that lie in
# the bin that holds a wanted place. Only counts meet, at most 2 ** BITS of them for a place, however large the group is.

BITS = 16
#: A bin with so few rows is counted by value at once.
SMALL = 1 << 18
#: Places known to the driver at most (groups x ranks); with more, each pass joins them instead.
KNOWN = 10_000


def _sortable(value: Column, kind: T.DataType) -> Column:
    """A long for each value, in the same order; NaN is the largest, as it is for Spark."""
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def order_statistics(df: DataFrame, group: Sequence[str], value: str, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(_group, n, vals): for each group the number of its values that aren't null, and the values at the places ``ranks(n)`` (from 0).

    Integers and doubles; other numbers are taken as doubles. Counts the values first; few take one more pass, many two where
    the wanted bins of the first are small, and four at most."""
    kind = df.schema[value].dataType
    v = F.col(value) if isinstance(kind, T.IntegralType) else F.col(value).cast("double") + F.lit(0.0)  # one zero
    keyed = df.where(F.col(value).isNotNull()).select(group_of(group).alias("_g"), v.alias("_v")).withColumn("_k", _sortable(F.col("_v"), kind))
    places, wanted, by, last = None, None, ["_g"], 64
    shift = 64 - BITS if keyed.count() > SMALL else 0
    while True:
        rows = keyed if places is None else keyed.withColumn("_bin", F.shiftright("_k", last)).join(wanted, ["_g", "_bin"])
        bins = rows.groupBy(*by, F.shiftright("_k", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"))
        run = bins.withColumn("_to", F.sum("_n").over(Window.partitionBy(*by).orderBy("_next")))
        if places is None:
            all_ = run.withColumn("n", F.sum("_n").over(Window.partitionBy("_g")))
            asked = F.array(*[F.struct(F.lit(i).alias("_i"), r.cast("long").alias("_at")) for i, r in enumerate(ranks(F.col("n")))])
            found = all_.select("*", F.explode(asked).alias("_p")).select("*", "_p.*")
        else:
            found = run.join(places.drop("_n", "_v"), by)
        found = found.where((F.col("_at") >= F.col("_to") - F.col("_n")) & (F.col("_at") < F.col("_to")))
        places = found.select("_g", "n", "_i", (F.col("_at") - F.col("_to") + F.col("_n")).alias("_at"), F.col("_next").alias("_bin"), "_n", "_v")
        if shift == 0:
            break
        known = places.limit(KNOWN + 1).collect()
        last, shift = shift, shift - BITS
        if len(known) <= KNOWN:
            schema = places.schema
            places = df.sparkSession.createDataFrame(known, schema)
            wanted = F.broadcast(places.select("_g", "_bin").distinct())  # at most KNOWN rows
            shift = 0 if all(r["_n"] <= SMALL for r in known) else shift
        else:
            wanted = places.select("_g", "_bin").distinct()
        by = ["_g", "_bin"]
    vals = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"])
    return places.groupBy("_g").agg(F.first("n").alias("n"), vals.alias("vals")).withColumnRenamed("_g", "_group")


def order_statistic(df: DataFrame, group: Sequence[str], value: str, index: Callable[[Column], Column], name: str) -> DataFrame:
    """Of each group the value at ``index(n)`` (from 0) of its n values in order."""
    got = order_statistics(df, group, value, lambda n: [index(n)])
    return got.select(*([F.col(f"_group.{c}").alias(c) for c in group]), F.element_at("vals", 1).alias(name))


def quantiles(df: DataFrame, group: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(_group, n, q): for each group its quantiles, interpolated between the two values next to the place q * (n - 1)."""
    place = lambda q, n: F.lit(float(q)) * (n - 1)
    got = order_statistics(df, group, value, lambda n: [f(place(q, n)) for q in fractions for f in (F.floor, F.ceil)])
    at = [place(q, F.col("n")) for q in fractions]
    low, high = ([F.element_at("vals", 2 * i + k).cast("double") for i in range(len(fractions))] for k in (1, 2))
    between = [F.when(a == F.floor(a), lo).otherwise(lo + (hi - lo) * (a - F.floor(a))) for a, lo, hi in zip(at, low, high)]
    return got.select("_group", "n", F.array(*between).alias("q"))


def throughput(df: DataFrame, status: str, wall_seconds: float) -> DataFrame:
    """(status, n, share, per_second) of a load test's requests; per_second is of all requests and the same in each row."""
    n = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy())  # a row for each status
    return n.select(status, "n", (F.col("n") / all_).alias("share"), F.bround(all_ / F.lit(float(wall_seconds)), 2).alias("per_second"))


def latency_summary(df: DataFrame, value: str, group: Sequence[str] = (), places: int | None = None) -> DataFrame:
    """Samples, smallest, median, 95th and 99th percentile (linear interpolation), largest, mean.

    ``places``: decimals of all figures, halves to even, as a report states them; else percentiles and mean have nine."""
    figures = df.groupBy(*group).agg(F.count(value).alias("samples"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")).withColumn("_group", group_of(group))
    out = figures.join(quantiles(df, group, value, (0.5, 0.95, 0.99)).select("_group", "q"), "_group", "left")
    told = (lambda c: F.round(c, 9)) if places is None else (lambda c: F.bround(c, places))
    ends = (lambda c: c) if places is None else told
    return out.select(
        *group, "samples", ends(F.col("min")).alias("min"), *[told(F.element_at("q", i + 1)).alias(f"p{p}") for i, p in enumerate((50, 95, 99))], ends(F.col("max")).alias("max"), told(F.col("mean")).alias("mean"),
    )


# --- bootstrap ---------------------------------------------------------------------------
# Draws are md5 picks of (draw, slot), so a seed gives the same draws on any engine and cluster. What is
# drawn are clusters' sums: draws * clusters narrow rows, joined on the cluster's number.


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Numbers the rows from 0 in the order of a hex key, without bringing them into one task.

    Rows are numbered within the key's first three digits; the 4,096 offsets are a small table."""
    df = df.withColumn("_p", F.substring(key, 1, 3))
    size = df.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    own = df.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    return own.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("bigint")).drop("_p", "_r", "_before")  # at most 4,096 rows


#: Rows that are drawn from on the map side at most (8 bytes each are broadcast), kinds of rows, rows of a broadcast chunk.
MAP_SIDE, KINDS, CHUNK = 5_000_000, BROADCAST_ROWS, 4096


def _picks(rows: DataFrame, strata: Sequence[str], columns: Sequence[str], draws: int, seed: str) -> DataFrame:
    """(draw, strata, columns), a row for each pick: of each stratum of rows(strata, idx, size, columns) as many as it has, with replacement.

    ``rows`` is a written table. Rows that agree in all columns are of one kind. The kind of each place (by hash, which is checked
    to tell kinds apart) is broadcast in chunks, so a pick becomes a row where it is drawn and what is summed
    of it crosses the shuffle once a task. With more rows or kinds than can be broadcast, picks are joined by place."""
    keys = ["_s"] if strata else []
    place = [group_of(strata).alias("_s")] if strata else []
    spread = rows.repartition(max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism))
    slots = spread.select(*place, *strata, F.col("idx").alias("slot"), "size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", *strata, "slot")), 1, 8), 16, 10).cast("bigint")
    picks = slots.select(*keys, "draw", (hashed % F.col("size")).alias("idx"))
    kind = F.xxhash64(*strata, *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    seen = [*strata, *columns]
    kinds = rows.groupBy(*seen).agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", kind).drop("_n")
    n, k, distinct = rows.count(), *kinds.agg(F.count(F.lit(1)), F.count_distinct("_kind")).first()
    if n <= MAP_SIDE and k <= KINDS and k == distinct:
        at = F.floor(F.col("idx") / CHUNK)
        own = F.transform(F.sort_array(F.collect_list(F.struct("idx", "_kind"))), lambda x: x["_kind"])
        chunks = rows.select(*place, "idx", kind.alias("_kind")).groupBy(*keys, at.alias("_chunk")).agg(own.alias("_kinds"))
        found = picks.withColumn("_chunk", at).join(F.broadcast(chunks), [*keys, "_chunk"]).select("draw", F.element_at("_kinds", (F.col("idx") % CHUNK + 1).cast("int")).alias("_kind"))
        return found.join(F.broadcast(kinds), "_kind").select("draw", *seen)
    return picks.join(rows.select(*place, "idx", *seen), [*keys, "idx"]).select("draw", *seen)


def cluster_draws(clusters: DataFrame, sums: Sequence[str], draws: int, seed: str, key: str = "cluster") -> DataFrame:
    """(draw, sums): as many clusters as there are, drawn with replacement, summed, for each draw.

    All sums of a draw come from the same clusters, so systems side by side are paired."""
    once = written(clusters.select(key, *sums))
    rows = written(dense_index(once, key).select("idx", F.lit(once.count()).alias("size"), *sums))
    return _picks(rows, (), sums, draws, seed).groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums])


def interval(df: DataFrame, value: str, prefix: str) -> list:
    """Aggregates: mean and the 95 % percentile interval of the draws in which the value is defined."""
    return [F.round(F.percentile(value, F.lit(0.025)), 9).alias(f"{prefix}_low"), F.round(F.percentile(value, F.lit(0.975)), 9).alias(f"{prefix}_high"), F.count(value).alias(f"{prefix}_draws")]


def order_interval(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """The other rule: sorted values at int(.025 n) and min(n - 1, int(.975 n)). Only the draws are sorted."""
    v = df.agg(F.array_sort(F.collect_list(value)).alias("v"))
    n = F.size("v")
    return v.select(
        F.round(F.get("v", F.floor(0.025 * n).cast("int")), 9).alias(f"{prefix}_low"),
        F.round(F.get("v", F.least(n - 1, F.floor(0.975 * n).cast("int"))), 9).alias(f"{prefix}_high"),
    )


def stratified_draws(rows: DataFrame, stratum: str, key: str, draws: int, seed: str) -> DataFrame:
    """(draw, stratum, the other columns of rows, picks): each stratum resampled to its own size, equal picks of a draw counted.

    Rows are numbered in the order of ``key``, which is left out."""
    other = [c for c in rows.columns if c not in (stratum, key)]
    placed = written(numbered(rows.select(stratum, key, *other), [stratum], [key], "idx"))
    sizes = placed.groupBy(group_of([stratum]).alias("_s")).agg(F.count(F.lit(1)).alias("size"))
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = placed.withColumn("_s", group_of([stratum])).join(F.broadcast(sizes) if few else sizes, "_s")
    ready = written(sized.select(stratum, (F.col("idx") - 1).alias("idx"), "size", *other))
    return _picks(ready, [stratum], other, draws, seed).groupBy("draw", stratum, *other).agg(F.count(F.lit(1)).alias("picks"))
