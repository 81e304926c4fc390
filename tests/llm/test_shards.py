"""Shards of op1's index: the graph of each by NN-descent, all of them walked by every query."""

import numpy as np
import pandas as pd
import pytest

from millrace.llm import ann

KIND = "vec_id long, embedding array<double>"


def _frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], KIND).repartition(3)


def _nearest(v, q, k):
    d = ((v - v[q]) ** 2).sum(1)
    d[q] = np.inf
    return set(np.argsort(d, kind="stable")[:k].tolist())


def test_the_search_does_not_take_a_job_a_step(spark):
    """Rounds and steps run within tasks: joins of the whole table at each were what took the time of large ones."""
    df = _frame(spark, np.random.default_rng(4).normal(size=(1500, 16)))
    spark.sparkContext.setJobGroup("shards", "op1")
    try:
        assert ann.search(df, df.where("vec_id % 30 = 0")).count() == 500
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards")) <= 60


def test_all_shards_are_searched(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 400)
    monkeypatch.setattr(ann, "PROBES", 8)  # the others walk in a second go
    rng = np.random.default_rng(6)
    v = rng.standard_normal((50, 16))[np.arange(1500) % 50] + 0.05 * rng.standard_normal((1500, 16))
    assert ann.shard_count(1500, 16) == 4
    df, got = _frame(spark, v), {}
    for r in ann.search(df, df.where("vec_id % 30 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == set(range(0, 1500, 30))
    assert sum(len(own & _nearest(v, q, 10)) for q, own in got.items()) >= 0.95 * 10 * len(got)


def test_bounds_of_a_shard():
    for count, dim in ((10, 4), (51_282, 64), (600_000, 64), (600_000, 1024), (60_000_000, 64)):
        n = ann.shard_count(count, dim)
        assert count / n <= ann.SHARD and count * dim / n <= ann.FLOATS
    assert ann.shard_count(2000, 64) == ann.shard_count(12_000, 64) == 1


@pytest.mark.parametrize("rows", [1, 2, 3, 40])
def test_small_graphs(rows):
    v = np.random.default_rng(rows).normal(size=(rows, 5)).astype(np.float32)
    ids = ann.nn_descent(v, 32)
    assert [len(set(x[x >= 0])) for x in ids] == [min(32, rows - 1)] * rows
    assert all(i not in x for i, x in enumerate(ids))


def test_nn_descent_improves_its_start():
    v = np.random.default_rng(7).normal(size=(4000, 24)).astype(np.float32)
    true = [_nearest(v, q, 32) for q in range(0, 4000, 40)]
    right = [np.mean([len(set(ids[q].tolist()) & t) / 32 for q, t in zip(range(0, 4000, 40), true)]) for ids in (ann.nn_descent(v, 32, rounds) for rounds in (0, 12))]
    assert right[0] < 0.75 and right[1] > 0.9


def test_parts_of_a_graph_are_all_reached():
    """Tight groups without links between them: a walk finds its group from whatever shard."""
    rng = np.random.default_rng(8)
    v = (rng.standard_normal((60, 16)) * 10)[np.arange(3000) % 60] + 0.01 * rng.standard_normal((3000, 16))
    shard = ann._shard(pd.DataFrame({"shard": 0, "node": np.arange(3000), "v": list(v.astype(np.float32))}), 32, 12, 256).iloc[0]
    links, pivots = np.frombuffer(shard["links"], np.int32).reshape(3000, -1), np.frombuffer(shard["pivots"], np.int64)
    short = v.astype(np.float32)
    ids, _, _ = ann._walk(short[:60] + np.float32(0.001), np.full(60, -1), short, (short**2).sum(1), links, pivots, 64, 32, 10)
    assert (ids % 60 == np.arange(60)[:, None]).all()
