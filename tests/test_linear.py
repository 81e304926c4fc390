"""Squared-hinge machines against Newton's method in numpy, and scores against plain TF-IDF."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import linear
from millrace.operators.checks import ConstraintError


def _newton(x, sign, c):
    """Minimises |w|^2 / 2 + sum(c * max(0, 1 - sign * x w)^2) for one machine."""
    w = np.zeros(x.shape[1])
    value = lambda w: w @ w / 2 + (c * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    for _ in range(200):
        short = np.maximum(0, 1 - sign * (x @ w))
        g = w - 2 * x.T @ (c * sign * short)
        on = short > 0
        h = np.eye(len(w)) + 2 * (x[on].T * c[on]) @ x[on]
        d, size = np.linalg.solve(h, g), 1.0
        while value(w - size * d) > value(w) - 1e-4 * size * (g @ d) and size > 1e-9:
            size /= 2
        w = w - size * d
        if np.linalg.norm(g) < 1e-10:
            break
    return w, value(w)


@pytest.mark.parametrize("balanced", [False, True])
def test_optimum(spark, balanced):
    rng = np.random.default_rng(3)
    y = rng.choice(3, 150, p=[0.6, 0.3, 0.1])
    x = np.where(rng.random((150, 20)) < 0.3, rng.normal(size=(150, 20)) + y[:, None] * 0.3, 0.0)
    rows = [(int(k), [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for k, r in zip(y, x)] + [(1, [], [])]
    y, x = np.append(y, 1), np.vstack([x, np.zeros(20)])
    got = linear.fit_squared_hinge(spark.createDataFrame(rows, "y int, idx array<int>, val array<double>").repartition(5), 3, 20, 0.7, balanced, 1e-7)
    one = np.hstack([x, np.ones((len(x), 1))])
    for j in range(3):
        sign = np.where(y == j, 1.0, -1.0)
        c = np.where(y == j, 0.7 * (len(y) / (3 * (y == j).sum()) if balanced else 1), 0.7)
        want, best = _newton(one, sign, c)
        mine = got[j] @ got[j] / 2 + (c * np.maximum(0, 1 - sign * (one @ got[j])) ** 2).sum()
        assert abs(mine - best) <= 1e-4 * best and np.abs(got[j] - want).max() < 1e-3


WORDS = {"de": "der und nicht haus wasser ist", "en": "the and not house water is", "fr": "le et pas maison eau est"}


def _texts(n):
    draw = random.Random(1)
    return [(i, " ".join(draw.choice(WORDS[k].split()) for _ in range(draw.randint(1, 6))), k) for i in range(n) for k in [draw.choice(sorted(WORDS))]]


def _plain_vectors(texts, low, high, idf):
    out = []
    for t in texts:
        tf = Counter(t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1))
        w = {g: (1 + math.log(c)) * idf[g] for g, c in tf.items() if g in idf}
        length = math.sqrt(sum(v * v for v in w.values()))
        out.append({g: v / length for g, v in w.items()})
    return out


@pytest.mark.parametrize("fit", [linear.fit_text, linear.fit_centroids])
def test_text_models(spark, fit):
    rows = _texts(90)
    train = spark.createDataFrame([*rows, (1000, "nobody", None)], "id long, text string, lang string").repartition(3)
    model = fit(train, "id", "text", "lang", 1, 2)
    assert model.labels == ("de", "en", "fr")
    df = Counter(g for _, t, _ in rows for g in {t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)})
    idf = {g: math.log((1 + len(rows)) / (1 + d)) + 1 for g, d in df.items() if d >= 2}
    table = {r.term: (r.idf, r.weights) for r in model.weights.collect()}
    assert {g: round(i, 9) for g, (i, _) in table.items()} == {g: round(i, 9) for g, i in idf.items()}
    asked = [(0, "der wasser"), (1, "the water"), (2, "漢字"), (3, ""), (4, None), (5, "le " * 4000)]
    got = {r.id: r for r in linear.score_text(spark.createDataFrame(asked, "id long, text string"), "id", "text", model).collect()}
    for i, t in asked:
        v = _plain_vectors([t or ""], 1, 2, idf)[0] if t and any(g in idf for g in t) else {}
        want = {k: sum(x * table[g][1][j] for g, x in v.items()) + model.intercepts[j] for j, k in enumerate(model.labels)}
        assert all(math.isclose(s.score, want[s.label], abs_tol=1e-9) for s in got[i].scores)
        assert got[i].label == min(want, key=lambda k: (-round(want[k], 12), k))
    held = linear.score_text(spark.createDataFrame([(i + 500, t, k) for i, t, k in _texts(60)], "id long, text string, lang string"), "id", "text", model)
    right = {i + 500: k for i, _, k in _texts(60)}
    assert sum(r.label == right[r.id] for r in held.collect()) >= 57


def test_refusals(spark):
    one = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id long, text string, lang string")
    for fit in (linear.fit_text, linear.fit_centroids):
        with pytest.raises(ConstraintError):
            fit(one, "id", "text", "lang", 1, 2)
    with pytest.raises(ConstraintError):
        linear.fit_squared_hinge(one, 10_000, 100_000)


def test_blocks_have_a_bound():
    """A batch was one block, which executors held whole and several times over."""
    idx = [[*range(n)] for n in (40_000, 30_000, 70_000, 0, 0, 5, 20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int32()), pa.array(idx, pa.list_(pa.int32())), pa.array([[float(x) for x in i] for i in idx], pa.list_(pa.float64()))], ["y", "idx", "val"])
    back = []
    for block in linear._packed(iter([batch.slice(0, 0), batch.slice(0, 3), batch.slice(3)])):
        y, ptr, i, val = (np.frombuffer(block.column(c)[0].as_py(), t) for c, t in enumerate((np.int32, np.int64, np.int32, np.float64)))
        assert len(y) == 1 or len(i) <= linear.BLOCK
        assert len(ptr) == len(y) + 1 and ptr[-1] == len(i) == len(val)
        back += [(int(k), i[a:b].tolist(), val[a:b].tolist()) for k, a, b in zip(y, ptr, ptr[1:])]
    assert back == [(k, i, [float(x) for x in i]) for k, i in enumerate(idx)]


def test_passes_keep_no_rows_in_memory(spark, monkeypatch):
    held, minimise = [], linear.minimise

    def watched(value, *rest):
        value(rest[0])
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return minimise(value, *rest)

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(linear, "minimise", watched)
    rows = [(i % 2, [i % 2, 2], [1.0, 0.5]) for i in range(40)]
    got = linear.fit_squared_hinge(spark.createDataFrame(rows, "y int, idx array<int>, val array<double>"), 2, 3)
    assert held == [before] and got[0, 0] > 0 > got[0, 1]
