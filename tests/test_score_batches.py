"""Scores by batches of newest rows are those of the stateful stream."""

import json

from millrace.streaming import predictions as stream


def test_newest_rows_count_once(spark, tmp_path):
    slots = "array<struct<type:string,value:string>>"
    gold = spark.createDataFrame([(str(i), f"a{i} b", [("date", f"a{i}")] if i % 2 else []) for i in range(6)], f"id string, utt string, slots {slots}")
    right = lambda i: json.dumps({"slots": [{"type": "date", "value": f"a{i}"}] if i % 2 else []})
    parts = [
        [(str(i), right(i) if i < 3 else "{", 1) for i in range(6)],
        [("3", right(3), 2), ("0", "{", 0), ("1", right(1), 1), ("9", right(9), 5), ("5", "[]", None)],
        [("3", "{", 1), ("4", right(4), 3), ("4", "{", 2)],
    ]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "id string, raw_output string, version long").write.mode("append").json(f"{tmp_path}/in")
        for score, name in ((stream.score_stream, "a"), (stream.score_batches, "b")):
            arriving = stream.read_predictions(spark, f"{tmp_path}/in", 100, stream.VERSIONED)
            score(arriving, gold, f"{tmp_path}/{name}", f"{tmp_path}/point-{name}").awaitTermination()
        assert stream.newest_scores(spark, f"{tmp_path}/b").first() == stream.kept_scores(spark, f"{tmp_path}/a").first()
    assert stream.newest_scores(spark, f"{tmp_path}/b").first().n_exact == 5
