"""Windows of characters and n-grams counted a text at a time; groups and clusters without what they don't read."""

from collections import Counter

from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.operators import ml, studies
from millrace.plans import resampling


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows(spark):
    texts = ["abc", "a", "x😀y", "abc", "", None]
    want = Counter()
    for t in filter(None, texts):
        c = [spans.BOUNDARY] * 2 + list(t) + [spans.BOUNDARY] * 2
        want.update(tuple(c[i : i + 5]) for i in range(len(t)))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).mapInArrow(spans.count_windows, spans.WINDOWS).collect()
    assert {tuple(r)[:5]: r.n for r in rows} == dict(want)


def test_terms_are_the_native_ngrams_and_are_not_aggregated_by_term(spark):
    df = spark.createDataFrame([(1, "abab😀"), (2, "a"), (3, ""), (4, None), (1, "ab")], "k long, t string")
    got = ml.term_counts(df, "k", "t", 1, 3)
    native = df.select("k", F.explode(ml.char_ngrams(F.col("t"), 1, 3)).alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, native.collect()))
    assert "Aggregate [k#" in _plan(got) and "term" not in _plan(got).split("Aggregate [k#")[1]


def test_texts_that_a_study_does_not_read_are_not_shuffled(spark):
    rows = spark.createDataFrame([("1", "u", [("date", "u")], True, "k")], "id string, utt string, slots array<struct<type:string,value:string>>, any_type boolean, key string")
    assert "min_by(utt" not in _plan(studies.study_groups(rows).select("key", "types", "negative"))
    assert "min_by(utt" in _plan(studies.study_groups(rows).select("utt"))


def test_paired_systems_are_not_joined(spark, sf):
    assert "Join" not in _plan(resampling.clusters(spark, sf))
