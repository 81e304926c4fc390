"""Expressions that are dear are made once a row, whatever reads them."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.operators import metrics
from millrace.plans import entities, fixtures
from millrace.tables import once


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_once_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, t string")
    got = once(df, t=F.upper("t"), u=F.lit(None).cast("string"))
    assert got.columns == ["i", "t", "u"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, None, None), (2, "B", None)]


def test_filters_do_not_repeat_the_parser(spark):
    df = spark.createDataFrame([("a", "[]", "x")], "id string, raw string, utt string")
    p = spans.with_parsed(df, "raw", "utt").select("id", F.col("p.slots").alias("slots"))
    plain, filtered = _plan(p), _plan(p.where(metrics.same_multiset(F.col("slots"), F.reverse("slots"))))
    assert filtered.count("regexp_extract_all") == plain.count("regexp_extract_all")
    assert filtered.count("_parse_rest(") == plain.count("_parse_rest(")


def test_slots_by_type_read_the_outputs_once(spark):
    rows = spark.createDataFrame([("a", [("date", "x")], "[]", "x")], "id string, slots array<struct<type:string,value:string>>, raw string, utt string")
    counts = metrics.entity_counts(spans.with_parsed(rows, "raw", "utt").withColumn("pred", F.col("p.slots")), "slots", "pred", "id")
    assert len(_plan(metrics.entity_prf_by_type(counts))) < 3 * len(_plan(counts))


def test_marks_are_placed_without_reading_the_line_at_each_word(spark, sf):
    assert "lambdafunction" not in _plan(fixtures.utterances(spark, sf).select("annot_utt"))


def test_the_aligner_runs_once(spark, sf):
    assert _plan(entities.align_gold(spark, sf)).count("align_annotations(") == 1


@pytest.mark.parametrize("own", [[], [("date", 0, 1)], [("time", 3, 5), ("date", 0, 3)], [("date", 1, 9)], [("date", 0, 3), ("time", 2, 4)], [("date", 2, 2)]])
def test_tags_of_sorted_unsorted_and_wrong_spans(spark, own):
    text = "ab de"
    df = spark.createDataFrame([(text, [(k, text[a:b], a, b) for k, a, b in own])], "utt string, spans array<struct<type:string,value:string,start:int,end:int>>")
    want = []
    for i in range(len(text)):
        k, a = next(((k, a) for k, a, b in own if a <= i < b), (None, None))
        want.append("O" if k is None else ("B-" if a == i else "I-") + k)
    assert df.select(spans.bio_tags(F.col("utt"), F.col("spans"))).first()[0] == want


def test_slots_of_tags_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "abcde", ["I-x", "I-x", "B-x", "O", "I-y"]), (2, "", []), (3, "ab", None), (4, "ab", ["B-x", None])], "id int, utt string, tags array<string>")
    got = spans.slots_from_bio(df, "id", "utt", "tags")
    assert "Join" not in _plan(got) and "Window" not in _plan(got)
    assert {r.id: [tuple(s) for s in r.slots] for r in got.collect()} == {1: [("x", "ab"), ("x", "c"), ("y", "e")], 2: [], 3: [], 4: [("x", "a")]}
