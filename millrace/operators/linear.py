"""Linear text classifiers: TF-IDF of character n-grams, one machine with squared hinge loss per class, scores from a weight table.

A model is a table (term, idf, weights: one for each class) with its labels and intercepts, so scoring is a join and sums of
expressions, and no model object has to be sent anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.tables import BROADCAST_ROWS, numbered, written

from .checks import ConstraintError
from .ml import term_counts

#: Weights of a model at most (classes x terms): they are sent to all tasks in each pass, 8 bytes each.
MOST_WEIGHTS = 50_000_000
#: Entries of a block of rows, and bytes of blocks that lie in one row group: a reader holds a group at a time.
BLOCK, GROUP_BYTES = 1 << 16, 4 << 20


@dataclass(frozen=True)
class LinearModel:
    """weights: (term, idf, weights array<double>), one weight for each label; intercepts in the order of the labels."""

    weights: DataFrame
    labels: tuple[str, ...]
    intercepts: tuple[float, ...]
    low: int
    high: int


def inverse_frequency(counts: DataFrame, texts: int, min_df: int = 2) -> DataFrame:
    """(term, idf) of the terms in at least min_df texts: ln((1 + n) / (1 + df)) + 1."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.select("term", (F.log((1 + F.lit(texts)) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, the columns of idf, w): (1 + ln tf) times idf, not yet divided by the row's length."""
    return counts.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf")).drop("tf")


# --- training ----------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, idx array, val array) as blocks, a row of four buffers each, of BLOCK entries and rows at most or of one row."""
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            ptr = batch.column("idx").offsets.to_numpy()[low:].astype(np.int64)
            ptr -= ptr[0]
            n = min(max(1, int(np.searchsorted(ptr, BLOCK, "right")) - 1), BLOCK)
            some = batch.slice(low, n)
            flat = some.column("y").to_numpy().astype(np.int32), ptr[: n + 1], some.column("idx").flatten().to_numpy().astype(np.int32), some.column("val").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in flat], ["y", "ptr", "idx", "val"])
            low += n


def _loss_and_gradient(block: tuple, w: np.ndarray, positive: np.ndarray, cost: float) -> tuple[float, np.ndarray]:
    """Of one block of rows: the loss over all machines, and its gradient (classes x (terms + 1), the intercept last)."""
    y, ptr, idx, val = block
    k, n = w.shape
    loss, grad = 0.0, np.zeros_like(w)
    step = max(1, int(4_000_000 // (k * max(1, len(idx) / max(1, len(y))))))
    for low in range(0, len(y), step):
        rows = slice(low, min(len(y), low + step))
        begin, end = ptr[rows.start], ptr[rows.stop]
        i, x = idx[begin:end], val[begin:end]
        of = np.repeat(np.arange(rows.stop - rows.start), np.diff(ptr[rows.start : rows.stop + 1]))
        for j in range(k):
            margin = np.bincount(of, x * w[j, i], rows.stop - rows.start) + w[j, -1]
            own = y[rows] == j
            sign, c = np.where(own, 1.0, -1.0), np.where(own, cost * positive[j], cost)
            short = np.maximum(0, 1 - sign * margin)
            loss += float((c * short**2).sum())
            pull = -2 * c * sign * short
            on = (pull != 0)[of]  # rows beyond the margin add nothing
            grad[j, :-1] += np.bincount(i[on], x[on] * pull[of[on]], n - 1)
            grad[j, -1] += pull.sum()
    return loss, grad


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float = 1e-4, most: int = 300, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking: until the gradient is ``tolerance`` of that at the start. Mostly one pass a step."""
    x = start
    f, g = value(x)
    first = np.linalg.norm(g)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(most):
        if np.linalg.norm(g) <= tolerance * first or first == 0:
            return x
        q, taken = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * np.vdot(s, q)
            q -= a * y
            taken.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            q *= np.vdot(s, y) / np.vdot(y, y)
        else:
            q /= max(1.0, first)
        for (s, y, rho), a in zip(pairs, reversed(taken)):
            q += (a - rho * np.vdot(y, q)) * s
        slope, size = -np.vdot(g, q), 1.0
        while True:
            there = x - size * q
            f2, g2 = value(there)
            if f2 <= f + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = there - x, g2 - g
        if np.vdot(s, y) > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / np.vdot(s, y))]
        x, f, g = there, f2, g2
    return x


def fit_squared_hinge(rows: DataFrame, classes: int, terms: int, cost: float = 1.0, balanced: bool = False, tolerance: float = 1e-4) -> np.ndarray:
    """rows(y int, idx array<int>, val array<double>) -> weights (classes x (terms + 1), the intercepts last).

    Minimises, for each class against the rest, half the squared length of the weights, the intercept among them, plus
    ``cost`` times the squared hinge losses; ``balanced`` weighs a class's own rows by n / (classes * its rows). All machines share the
    passes over the data. A pass sends the weights to all tasks and adds losses and gradients as a tree; it reads the rows from a
    written table of small blocks, a few at a time, so what executors hold doesn't grow with the rows."""
    if classes * (terms + 1) > MOST_WEIGHTS:
        raise ConstraintError(f"more than {MOST_WEIGHTS} weights")
    sc = rows.sparkSession.sparkContext
    packed = written(rows.select("y", "idx", "val").mapInArrow(_packed, "y binary, ptr binary, idx binary, val binary"), GROUP_BYTES)
    kinds = (np.int32, np.int64, np.int32, np.float64)
    positive = np.ones(classes)
    if balanced:
        own = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
        positive = np.array([sum(own.values()) / (classes * own[j]) if j in own else 1.0 for j in range(classes)])

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(w)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = 0.0, np.zeros_like(sent.value)
            for batch in batches:
                for row in range(batch.num_rows):
                    block = tuple(np.frombuffer(column[row].as_buffer(), kind) for column, kind in zip(batch.columns, kinds))
                    own, g = _loss_and_gradient(block, sent.value, positive, cost)
                    loss += own
                    grad += g
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["loss", "grad"])

        add = lambda a, b: b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])
        sums = packed.mapInArrow(part, "loss double, grad binary").rdd.map(lambda r: (r["loss"], np.frombuffer(r["grad"]).reshape(classes, terms + 1)))
        total = sums.treeAggregate(None, add, add)
        sent.destroy()
        loss, grad = total or (0.0, np.zeros_like(w))
        return 0.5 * float(np.vdot(w, w)) + loss, w + grad

    return minimise(value, np.zeros((classes, terms + 1)), tolerance)


def fit_text(train: DataFrame, key: str, text: str, label: str, low: int, high: int, min_df: int = 2, cost: float = 1.0, balanced: bool = False, tolerance: float = 1e-4) -> LinearModel:
    """A model of train(key, text, label); rows without a label are left out. Its weight table is written to the shared folder."""
    train = written(train.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).cast("string").alias("_label")))
    labels = tuple(sorted(r[0] for r in train.select("_label").distinct().limit(10_001).collect()))
    if not 1 < len(labels) <= 10_000:
        raise ConstraintError("a classifier takes 2 to 10,000 labels")
    counts = written(term_counts(train, "_key", "_text", low, high))
    vocabulary = written(numbered(inverse_frequency(counts, train.count(), min_df), (), ["term"], "n"))
    terms = vocabulary.count()
    w = weighted(counts, "_key", F.broadcast(vocabulary) if terms <= BROADCAST_ROWS else vocabulary)
    vector = F.sort_array(F.collect_list(F.struct((F.col("n") - 1).cast("int").alias("i"), "w")))
    rows = w.groupBy("_key").agg(vector.alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    place = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    rows = train.select("_key", F.element_at(place, F.col("_label")).alias("y")).join(rows, "_key", "left")
    none = F.expr("cast(array() as array<struct<i:int,w:double>>)")
    rows = written(rows.select("y", F.coalesce("v", none).alias("v"), "length").select("y", F.col("v.i").alias("idx"), F.transform("v", lambda x: x["w"] / F.col("length")).alias("val")))
    fitted = fit_squared_hinge(rows, len(labels), terms, cost, balanced, tolerance)
    spark = train.sparkSession
    table = spark.createDataFrame(pa.table({"n": pa.array(np.arange(1, terms + 1)), "weights": pa.array(list(fitted[:, :-1].T), pa.list_(pa.float64()))}))
    return LinearModel(written(vocabulary.join(table, "n").select("term", "idf", "weights")), labels, tuple(map(float, fitted[:, -1])), low, high)


# --- scoring -----------------------------------------------------------------------------


def score_text(df: DataFrame, key: str, text: str, model: LinearModel) -> DataFrame:
    """(key, scores: label, score, highest first, ties by label; label: the first): the score of each row for each label.

    A text without a known term has the intercepts."""
    few = model.weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    w = weighted(term_counts(df, key, text, model.low, model.high), key, F.broadcast(model.weights) if few else model.weights)
    sums = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"), *[F.sum(F.col("w") * F.get("weights", F.lit(j))).alias(f"_s{j}") for j in range(len(model.labels))])
    every = df.select(key).join(sums, key, "left")
    score = lambda j: F.coalesce(F.col(f"_s{j}") / F.col("_length"), F.lit(0.0)) + F.lit(model.intercepts[j])
    scores = F.array(*[F.struct((-score(j)).alias("minus"), F.lit(name).alias("label")) for j, name in enumerate(model.labels)])
    ordered = F.transform(F.sort_array(scores), lambda s: F.struct(s["label"].alias("label"), (-s["minus"]).alias("score")))
    return every.select(key, ordered.alias("scores")).withColumn("label", F.get("scores", F.lit(0))["label"])


def fit_centroids(train: DataFrame, key: str, text: str, label: str, low: int, high: int, min_df: int = 2) -> LinearModel:
    """The plain alternative to machines: a class's weights are the mean of its texts' vectors of length 1, the intercepts zero."""
    train = written(train.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).cast("string").alias("_label")))
    sizes = {r["_label"]: r["n"] for r in train.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).limit(10_001).collect()}
    labels = tuple(sorted(sizes))
    if not 1 < len(labels) <= 10_000:
        raise ConstraintError("a classifier takes 2 to 10,000 labels")
    counts = written(term_counts(train, "_key", "_text", low, high))
    idf = written(inverse_frequency(counts, train.count(), min_df))
    w = weighted(counts, "_key", F.broadcast(idf) if idf.count() <= BROADCAST_ROWS else idf)
    length = w.groupBy("_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    unit = w.join(length, "_key").join(train.select("_key", "_label"), "_key")
    means = [(F.coalesce(F.sum(F.when(F.col("_label") == name, F.col("w") / F.col("length"))), F.lit(0.0)) / sizes[name]) for name in labels]
    table = unit.groupBy("term", "idf").agg(F.array(*means).alias("weights"))
    return LinearModel(written(table), labels, (0.0,) * len(labels), low, high)
