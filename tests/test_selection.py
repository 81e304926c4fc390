"""Order statistics, resampling and dependent draws against plain versions, on the paths for small and for large groups."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import tables
from millrace.operators import sampling, stats, studies
from millrace.operators.checks import ConstraintError


def _values(draw):
    out = [(g, draw.choice([draw.gauss(0, 1e3), float(draw.randint(-3, 3)), draw.uniform(0, 1e-300), -(10.0 ** draw.randint(-320, 300))])) for g in ("a", "b", None) for _ in range(200)]
    out += [("one", -0.0), ("pair", 0.0), ("pair", -0.0), ("odd", math.inf), ("odd", -math.inf), ("odd", 5e-324), ("odd", None), ("none", None)]
    return out + [("same", 2.5)] * 300


@pytest.mark.parametrize("small, known", [(1 << 18, 10_000), (3, 10_000), (3, 2)])
def test_order_statistics(spark, monkeypatch, small, known):
    monkeypatch.setattr(stats, "SMALL", small)
    monkeypatch.setattr(stats, "KNOWN", known)
    rows = _values(random.Random(2))
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    places = lambda n: [F.lit(0), F.floor(n / 3), n - 1]
    got = {r._group.g: (r.n, list(r.vals)) for r in stats.order_statistics(df, ["g"], "v", places).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(v + 0.0 for k, v in rows if k == g and v is not None)
        if own:
            want[g] = (len(own), [own[0], own[len(own) // 3], own[-1]])
    assert got == want
    q = {r._group.g: r.q for r in stats.quantiles(df.where("g <> 'odd'"), ["g"], "v", (0.0, 0.5, 0.95)).collect()}
    for g, (n, _) in want.items():
        if g not in (None, "odd"):
            own = sorted(v + 0.0 for k, v in rows if k == g)
            for f, x in zip((0.0, 0.5, 0.95), q[g]):
                at = f * (n - 1)
                low = math.floor(at)
                assert math.isclose(x, own[low] + (own[min(low + 1, n - 1)] - own[low]) * (at - low), rel_tol=1e-12, abs_tol=1e-320)


def test_whole_numbers_keep_all_digits(spark):
    big = 2**60
    df = spark.createDataFrame([(big + i,) for i in range(-50, 51)], "v long")
    assert stats.order_statistic(df, [], "v", lambda n: F.floor(n / 2), "m").first().m == big


def test_latency_summary(spark):
    values = [1.005, 2.675, 3.0, 10.125, 7.0, None]
    df = spark.createDataFrame([(g, v) for g in ("x", None) for v in values] + [("empty", None)], "g string, v double")
    got = {r.g: r for r in stats.latency_summary(df, "v", ["g"], places=2).collect()}
    assert set(got) == {"x", None, "empty"} and (got["empty"].samples, got["empty"].p50) == (0, None)
    for g in ("x", None):
        r = got[g]
        assert (r.samples, r.min, r.p50, r.max, r.mean) == (5, 1.0, 3.0, 10.12, 4.76) and r.p95 == round(7 + 3.125 * 0.8, 2)
    assert stats.latency_summary(df.where("g = 'x'"), "v").collect()[0].p50 == 3.0
    assert stats.latency_summary(df.where("false"), "v", ["g"]).collect() == []


def test_one_large_group(spark, monkeypatch):
    """200,000 distinct values of one group, through several passes that join counts alone."""
    monkeypatch.setattr(stats, "SMALL", 1000)
    df = spark.range(0, 200_000, 1, 8).select(F.lit("g").alias("g"), (F.xxhash64("id") % 1_000_000 / 7.0).alias("v"))
    got = stats.quantiles(df, ["g"], "v", (0.5,))
    assert "percentile" not in got._jdf.queryExecution().toString()
    own = sorted(r.v for r in df.collect())
    assert math.isclose(got.first().q[0], (own[99_999] + own[100_000]) / 2)


def _plain_draws(clusters, draws, seed):
    own = sorted(clusters)
    out = []
    for d in range(draws):
        sums = [0] * (len(own[0]) - 1)
        for slot in range(len(own)):
            pick = own[int(hashlib.md5(f"{seed}|{d}|{slot}".encode()).hexdigest()[:8], 16) % len(own)]
            sums = [a + b for a, b in zip(sums, pick[1:])]
        out.append((d, *sums))
    return out


@pytest.mark.parametrize("map_side", [5_000_000, 0])
def test_cluster_draws(spark, monkeypatch, map_side):
    monkeypatch.setattr(stats, "MAP_SIDE", map_side)
    monkeypatch.setattr(stats, "CHUNK", 16)
    draw = random.Random(4)
    clusters = [(hashlib.sha256(str(i).encode()).hexdigest(), draw.randint(0, 2), draw.randint(0, 1)) for i in range(90)]
    df = spark.createDataFrame(clusters, "cluster string, tp long, fp long").repartition(3)
    assert sorted(map(tuple, stats.cluster_draws(df, ["tp", "fp"], 12, "s").collect())) == _plain_draws(clusters, 12, "s")
    assert stats.cluster_draws(df.where("false"), ["tp", "fp"], 12, "s").collect() == []


@pytest.mark.parametrize("map_side", [5_000_000, 0])
def test_stratified_draws(spark, monkeypatch, map_side):
    monkeypatch.setattr(stats, "MAP_SIDE", map_side)
    monkeypatch.setattr(stats, "CHUNK", 16)
    monkeypatch.setattr(tables, "RANGE_ROWS", 9)
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "b", "rare"] if i == 7 else ["a", "b"]), draw.choice(["x", None]), draw.choice(["x", "y"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, s string, p string, q string").repartition(5)
    got = {(r.draw, r.s, r.p, r.q): r.picks for r in stats.stratified_draws(df, "s", "id", 6, "z").collect()}
    want = Counter()
    for s in {r[1] for r in rows}:
        own = [r for r in sorted(rows) if r[1] == s]
        for d in range(6):
            for slot in range(len(own)):
                _, _, p, q = own[int(hashlib.md5(f"z|{d}|{s}|{slot}".encode()).hexdigest()[:8], 16) % len(own)]
                want[d, s, p, q] += 1
    assert got == dict(want)


def test_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 7)
    rows = [(g, i) for g in ("a", None, "b") for i in range(30)] + [("c", 1)]
    got = tables.numbered(spark.createDataFrame(rows, "g string, i long").repartition(6), ["g"], ["i"], "n").collect()
    assert len(got) == len(rows) and all(r.n == (r.i + 1 if r.g != "c" else 1) for r in got)


def _in_turn(lists, quotas):
    used, out = set(), []
    for step in sorted(quotas):
        own = [k for _, k in sorted(lists.get(step, ())) if k not in used][: quotas[step]]
        used.update(own)
        out += [(step, k) for k in own]
    return sorted(out)


@pytest.mark.parametrize("one_task", [100_000, 0])
@pytest.mark.parametrize("seed", range(2))
def test_settle_is_taking_turns(spark, monkeypatch, one_task, seed):
    """Steps whose lists overlap in chains, with tied ranks, quotas of zero and beyond the list."""
    monkeypatch.setattr(sampling, "ONE_TASK", one_task)
    draw = random.Random(seed)
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(12)]
    lists = {s: {(draw.choice(hexes), f"k{draw.randint(0, 40)}") for _ in range(draw.randint(5, 30))} for s in range(6)}
    lists = {s: {(min(r for r, k2 in own if k2 == k), k) for _, k in own} for s, own in lists.items()}
    quotas = {s: draw.choice([0, 1, 4, 7, 100]) for s in range(7)}
    rows = [(s, r, k) for s, own in lists.items() for r, k in own]
    df = spark.createDataFrame(rows, "_step int, rank string, key string").repartition(4)
    assert sorted((r._step, r.key) for r in sampling.settle(df, quotas).collect()) == _in_turn(lists, quotas)


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_draws(spark, monkeypatch, one_task):
    monkeypatch.setattr(sampling, "ONE_TASK", one_task)
    monkeypatch.setattr(tables, "ONE_TASK", one_task)
    draw = random.Random(9)
    rank = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
    rows = [(s, b, rank(s, b, k), f"k{k}") for s in ("dev", "train") for b in "xyz" for k in range(60) if draw.random() < 0.5]
    steps = [("dev", "x", 5), ("dev", "y", 5), ("train", "x", 50), ("train", "z", 9), ("train", "absent", 2)]
    df = spark.createDataFrame(rows, "split string, bucket string, rank string, key string")
    lists = {i: {(r, k) for s2, b2, r, k in rows if (s2, b2) == (s, b)} for i, (s, b, _) in enumerate(steps)}
    ranks = {(s, b, k): r for s, b, r, k in rows}
    want, seen = [], Counter()
    for i, k in sorted(_in_turn(lists, {i: q for i, (*_, q) in enumerate(steps)}), key=lambda t: (t[0], ranks[(*steps[t[0]][:2], t[1])])):
        seen[i] += 1
        want.append((*steps[i][:2], k, seen[i]))
    assert sorted(map(tuple, sampling.quota_sample(df, steps).collect())) == sorted(want)
    labels = df.where("split = 'dev'").select("bucket", "rank", "key").unionByName(spark.createDataFrame([(None, "0", "k1")], "bucket string, rank string, key string"))
    got = sorted(map(tuple, sampling.unique_take(labels, "bucket", "key", "rank", 6, 3).select("bucket", "key").collect()))
    by = {i: {(r, k) for s, b2, r, k in rows if (s, b2) == ("dev", b)} for i, b in enumerate("xyz")}
    assert got == sorted(("xyz"[i], k) for i, k in _in_turn(by, dict.fromkeys(range(3), 6)))
    with pytest.raises(ConstraintError):
        sampling.unique_take(labels, "bucket", "key", "rank", 6, 2)
    assert sampling.unique_take(labels.where("false"), "bucket", "key", "rank", 6, 2).collect() == []
    held = sampling.natural_holdout(df.where("split = 'dev' and bucket = 'x'"), "rank", "key", [("one", 3), ("two", 4)]).select("key", "split", "ord").collect()
    own = [k for _, k in sorted(lists[0])][:7]
    assert sorted((r.ord, r.key, r.split) for r in held) == [(i + 1, k, "one" if i < 3 else "two") for i, k in enumerate(own)]


def test_study_clash_moves_to_the_next_key(spark):
    """A key that an earlier step of the plan has taken is replaced by the next of the later step's list."""
    study = spark.createDataFrame([(f"k{i}", "eligible", ["date", "person"] if i < 8 else ["person"], None) for i in range(20)], "key string, status string, types array<string>, negative string")
    plan = studies.Plan(("p",), (("dev", 3),), (("train", "date", 4), ("train", "person", 6)))
    got = studies.draw(study, plan).collect()
    assert len(got) == len({r.key for r in got}) == 13 and Counter((r.split, r.bucket) for r in got) == {("dev", "natural"): 3, ("train", "date"): 4, ("train", "person"): 6}
    assert studies.shortfalls(studies.draw(study, plan), plan).count() == 0
