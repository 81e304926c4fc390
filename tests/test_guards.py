"""What raises: alignment, gold, studies, locks, readers and writers; models there and back."""

import io
import json
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import checks, datasets, evaluation, gates, locks, ml, sampling, studies
from millrace.sinks import jsonl as sink
from millrace.sources import archive, files, jsonl, manifests
from millrace.streaming import predictions as streaming

E, F64 = "e" * 64, "f" * 64
GOLD = [(str(i), f"{i:064x}", f"text {i}") for i in range(6)]
REC = "id string, group_sha256 string, eval_file_sha256 string, raw_output string"


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame(GOLD, "id string, group_sha256 string, utt string")


def records(spark, change=lambda rows: rows):
    return spark.createDataFrame(change([(i, g, E, f"out {i}") for i, g, _ in reversed(GOLD)]), REC)


def test_alignment(spark, gold):
    both = evaluation.align(gold, {"a": records(spark), "b": records(spark).repartition(3)}, E).collect()
    assert {(r.id, r.a, r.b) for r in both} == {(i, f"out {i}", f"out {i}") for i, *_ in GOLD}
    spoilt = {
        "duplicate_prediction": lambda r: r + r[:1],
        "missing_prediction": lambda r: r[1:],
        "extra_prediction": lambda r: [*r, ("new", r[0][1], E, "x")],
        "foreign_group": lambda r: [(r[0][0], F64, E, "x"), *r[1:]],
        "foreign_file": lambda r: [(*r[0][:2], F64, "x"), *r[1:]],
        "missing_output": lambda r: [(*r[0][:3], None), *r[1:]],
    }
    for name, change in spoilt.items():
        bad = records(spark, change)
        assert {r.violation for r in evaluation.alignment_violations(gold, bad, E).collect()} == {name}
        with pytest.raises(checks.ConstraintError, match=name):
            evaluation.align(gold, {"a": bad}, E)
    with pytest.raises(checks.ConstraintError, match="duplicate_gold"):
        evaluation.align(gold.unionByName(gold.limit(1)), {"a": records(spark)}, E)


def test_scores_refuse_what_does_not_fit(spark, gold):
    g = gold.select("id", F.lit("x").alias("intent"))
    p = gold.select("id", F.lit(None).cast("string").alias("prediction"), F.lit(" x ").alias("raw_output"))
    assert evaluation.score_classification(g, p, ["x", "y"]).first().n_correct == 6
    with pytest.raises(checks.ConstraintError):
        evaluation.score_classification(g, p.limit(5), ["x"])
    slots = "array<struct<type:string,value:string>>"
    rows = [("a", "on may 1", [("date", "may 1")], [("date", "may 1")]), ("b", "x", [], None)]
    df = spark.createDataFrame(rows, f"id string, utt string, gold {slots}, pred {slots}")
    r = evaluation.score_entities(df, "id", "utt", "gold", "pred").first()
    assert (r.micro_f1, r.macro_f1) == (1.0, 0.25)
    for bad in ([("song", "x")], [("date", "")], [("date", "y")], None, [("date", None)]):
        with pytest.raises(checks.ConstraintError):
            evaluation.score_entities(spark.createDataFrame([("b", "x", bad, None)], df.schema), "id", "utt", "gold", "pred")


def test_positions(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q")], "ord long, id string")
    assert evaluation.align_by_position(a, a, key="id").count() == 2
    for other in ([(1, "p")], [(1, "p"), (1, "q"), (2, "q")], [(1, "q"), (2, "p")]):
        with pytest.raises(checks.ConstraintError):
            evaluation.align_by_position(a, spark.createDataFrame(other, a.schema), key="id")


def source(spark, n=60):
    kind = lambda i: [] if i % 3 == 0 else [(studies.TARGET_TYPES[i % 4], f"v{i}")]
    rows = [(str(i), "train", f"say v{i}", kind(i), i % 6 != 0, f"sayv{i}") for i in range(n)] + [("900", "train", "say, v1", [], False, "sayv1"), ("901", "train", "...", [], False, "")]
    return spark.createDataFrame(rows, "id string, partition string, utt string, slots array<struct<type:string,value:string>>, any_type boolean, key string")


def test_study(spark):
    rows = source(spark)
    prior, reserved = spark.createDataFrame([("sayv5",)], "key string"), spark.createDataFrame([("sayv7",)], "key string").select(F.sha2("key", 256).alias("group_sha256"))
    plan = studies.Plan(("s", "1"), (("confirmation", 5), ("dev", 4)), studies.training_mix(4, 3, 3))
    out, audit = studies.build(rows, plan, prior, reserved)
    drawn = out.collect()
    assert len({r.group_sha256 for r in drawn}) == len(drawn) == 9 + 16 + 6
    assert {r.utt for r in drawn} <= {f"say v{i}" for i in range(60)} - {"say v1", "say v5", "say v7"}
    a = audit.first()
    assert (a.n_rows, a.n_empty_groups, a.n_prior_groups, a.n_conflict_groups, a.n_conflict_rows, a.n_eligible_groups) == (62, 1, 2, 1, 2, 57)
    assert {(r.split, r.ord) for r in drawn} == {(s, i + 1) for s, n in (("confirmation", 5), ("dev", 4), ("train", 22)) for i in range(n)}
    again = studies.build(rows.repartition(3), plan, prior, reserved)[0].collect()
    assert {(r.split, r.ord, r.id) for r in again} == {(r.split, r.ord, r.id) for r in drawn}
    with pytest.raises(checks.ConstraintError, match="too few"):
        studies.build(rows, studies.Plan(("s", "1"), (), (("train", "date", 500),)))
    for bad in (rows.withColumn("partition", F.lit("dev")), rows.unionByName(rows.limit(1)), rows.withColumn("utt", F.lit(" "))):
        with pytest.raises(checks.ConstraintError, match="invalid source"):
            studies.build(bad, plan)
    with pytest.raises(checks.ConstraintError, match="shares groups"):
        studies.reserve([reserved], "again", reserved)
    summary = {r.split: (r.n, r.n_positive) for r in studies.sealed_summary(out, ("confirmation",)).collect()}
    assert summary["confirmation"] == (5, None) and summary["train"] == (22, 16)


def test_draws_that_fall_short(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert {(r.k, r.v) for r in sampling.shuffle_take(df, "k", "7", 5).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(checks.ConstraintError):
        sampling.shuffle_take(df, "k", "7", 3, strict=True)
    cols = "json_valid_rate double, schema_valid_rate double, copy_valid_rate double, micro_f1 double, n_no_slot_failure long, n_no_slot long, system string, step long"
    with pytest.raises(checks.ConstraintError):
        gates.require_checkpoint(spark.createDataFrame([(0.9, 0.9, 0.9, 0.9, 0, 1, "a", 1)], cols))


def test_locks(spark, tmp_path):
    for role in ("dev", "test"):
        (tmp_path / f"{role}.jsonl").write_text(f'{{"role":"{role}"}}\n')
    entry = {r: {"jsonl_sha256": locks.file_sha256(spark, f"{tmp_path}/{r}.jsonl")} for r in ("dev", "test")}
    facts = {"format_version": 1, "source_partition_used": "train", "source_sha256": E}
    (tmp_path / "manifest.json").write_text(json.dumps(facts | {"splits": entry}))
    assert locks.preflight(spark, f"{tmp_path}/dev.jsonl", "dev", facts)["splits"] == entry
    for path, role, want in ((f"{tmp_path}/dev.jsonl", "test", facts), (f"{tmp_path}/dev.jsonl", "other", facts), (f"{tmp_path}/dev.jsonl", "dev", facts | {"source_sha256": F64})):
        with pytest.raises(checks.ConstraintError):
            locks.preflight(spark, path, role, want)
    report = {"role": "dev", "manifest": E, "checks": {"f1": True}}
    lock = locks.compose_lock(report, {"role": "dev", "manifest": E}, {"f1": True}, test_file=entry["test"]["jsonl_sha256"])
    for bad, decision in ((report, {"f1": False}), (report | {"manifest": F64}, {"f1": True}), (report | {"checks": {}}, {"f1": True})):
        with pytest.raises(checks.ConstraintError):
            locks.compose_lock(bad, {"role": "dev", "manifest": E}, decision)
    (tmp_path / "lock.json").write_text(json.dumps(lock))
    digest = locks.file_sha256(spark, f"{tmp_path}/lock.json")
    asked = []
    read = lambda: asked.append(1) or spark.range(1)
    assert locks.held_out(spark, f"{tmp_path}/lock.json", digest, lambda: {"manifest": E}, read).count() == 1
    for sha, now in ((F64, {"manifest": E}), (digest, {"manifest": F64})):
        with pytest.raises(checks.ConstraintError):
            locks.held_out(spark, f"{tmp_path}/lock.json", sha, lambda now=now: now, read)
    assert len(asked) == 1
    with locks.frozen(spark, [f"{tmp_path}/dev.jsonl"]):
        pass
    with pytest.raises(checks.ConstraintError), locks.frozen(spark, [f"{tmp_path}/dev.jsonl"]):
        (tmp_path / "dev.jsonl").write_text("other")
    with pytest.raises(checks.ConstraintError):
        locks.preflight(spark, f"{tmp_path}/dev.jsonl", "dev", facts)


def test_earlier_assets(spark, tmp_path):
    official = spark.createDataFrame([(i, f"k{i}") for i in range(9)], "id long, key string")
    keys, counts = locks.prior_assets(official, {"a": official.where("id < 3"), "b": official.where("id < 5")}, {"a": 3, "b": 5}, "key")
    assert keys.count() == 5 and {(r.asset, r.n) for r in counts.collect()} == {("a", 3), ("b", 5)}
    for old in (official.withColumn("key", F.lit("k0")), official.withColumn("id", F.col("id") + 5), official.unionByName(official)):
        with pytest.raises(checks.ConstraintError):
            locks.prior_assets(official, {"a": old}, {"a": old.count()}, "key")
    with pytest.raises(checks.ConstraintError):
        locks.prior_assets(official, {"a": official}, {"a": 8}, "key")
    (tmp_path / "test.jsonl").write_text("x\n")
    manifest = {"test_group_sha256": [E, F64], "test_jsonl_sha256": locks.file_sha256(spark, f"{tmp_path}/test.jsonl")}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert {r.group_sha256 for r in manifests.reserved_test_hashes(spark, f"{tmp_path}/m.json", f"{tmp_path}/test.jsonl").collect()} == {E, F64}
    (tmp_path / "test.jsonl").write_text("y\n")
    with pytest.raises(checks.ConstraintError):
        manifests.reserved_test_hashes(spark, f"{tmp_path}/m.json", f"{tmp_path}/test.jsonl")


def test_readers(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": 1, "prediction": 5, "raw_output": "a"}\n\n{"id": "x", "prediction": ["a"], "raw_output": {"a": 1}}\n{"id": "y", "prediction": "b", "raw_output": null}\n[1]\nbroken\n')
    got = [(r.id, r.prediction, r.raw_output, r.error) for r in jsonl.predictions(spark, f"{tmp_path}/p.jsonl").collect()]
    assert sorted(got, key=str) == sorted([("1", None, "a", None), ("x", None, None, None), ("y", "b", None, None), (None, None, None, "[1]"), (None, None, None, "broken")], key=str)
    schema = T.StructType.fromDDL("a long, b string")
    (tmp_path / "o.json").write_text('{\n"a": 1, "b": "x"}')
    assert jsonl.load_object(spark, f"{tmp_path}/o.json", schema).collect() == [(1, "x")]
    for bad in ('[{"a": 1}, {"a": 2}]', '{"a": 1}\n{"a": 2}', "5", ""):
        (tmp_path / "o.json").write_text(bad)
        with pytest.raises(PySparkException):
            jsonl.load_object(spark, f"{tmp_path}/o.json", schema).collect()
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n')
    assert jsonl.json_table(spark, f"{tmp_path}/t.jsonl", schema, ["b"]).collect() == [("x",)]
    revision = "0123456789" * 4
    (tmp_path / revision).mkdir()
    (tmp_path / revision / "t.jsonl").write_text('{"a": 2, "b": "y"}\n')
    assert jsonl.pinned(spark, str(tmp_path), revision, schema).collect() == [(2, "y")]
    with pytest.raises(ValueError):
        jsonl.pinned(spark, str(tmp_path), "main", schema)
    assert jsonl.named_path("a-1=x=y") == ("a-1", "x=y")
    for bad in ("=x", "a=", "1a=x", "a" * 41 + "=x", "a"):
        with pytest.raises(ValueError):
            jsonl.named_path(bad)


def test_archive(spark, tmp_path):
    rows = [{"id": str(i), "partition": p, "locale": "zh-CN", "scenario": "s", "utt": "u", "intent": "n"} for i, p in enumerate(("train", "train", "dev"))]
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name, body in (("d/zh-CN.jsonl", "\n".join(map(json.dumps, rows))), ("d/LICENSE", "free")):
            info = tarfile.TarInfo(name)
            info.size = len(body.encode())
            tar.addfile(info, io.BytesIO(body.encode()))
    schema = T.StructType.fromDDL("id string, partition string, locale string, scenario string, utt string, intent string")
    read, licence = archive.read_with_licence(spark, f"{tmp_path}/x.tar", schema)
    assert licence == b"free" and read.count() == 3
    assert archive.load_partitions(read, ("train", "dev"), "zh-CN").count() == 3
    for bad in (lambda: archive.load_partitions(read, ("train",), "zh-CN"), lambda: archive.load_partitions(read, ("train", "dev"), "de-DE"), lambda: archive.load_partitions(read.withColumn("intent", F.lit(" ")), ("train", "dev"), "zh-CN")):
        with pytest.raises(PySparkException):
            bad().collect()
    assert archive.partition_violations(read, {"train": 2, "dev": 1}).count() == 0
    twice = read.unionByName(read.limit(1)).unionByName(read.where("id = '2'").withColumn("partition", F.lit("train")))
    assert {r.what for r in archive.partition_violations(twice, {"train": 2, "dev": 1}).collect()} == {"size of train", "repeated ids", "shared ids"}


def test_writers(spark, tmp_path):
    cases = spark.createDataFrame([("a", 'say "x", ü'), ("b", None)], "case string, text string")
    sink.write_rating_template(cases, f"{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_bytes() == '﻿case,text\r\na,"say ""x"", ü"\r\nb,\r\n'.encode()
    with pytest.raises(Exception, match="exist"):
        sink.write_rating_template(cases, f"{tmp_path}/r.csv")
    assert sink.public_columns(cases.withColumn("_x", F.lit(1))).columns == ["case", "text"]
    with pytest.raises(ValueError, match="utt"):
        sink.aggregates_only(spark.createDataFrame([], "n long, more array<struct<utt:string>>"))
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out")
    assert sink.confined(f"{tmp_path}/in/x", f"{tmp_path}/in")
    with pytest.raises(ValueError):
        sink.confined(f"{tmp_path}/in/link/x", f"{tmp_path}/in")
    df = spark.createDataFrame([("1", E, "on may", '{"slots":[{"type":"date","value":"may"}]}')], "id string, group_sha256 string, utt string, raw_output string")
    r = sink.parsed_payload(df, F64).first()
    assert (r.prediction[0].value, r.validity.copy_valid, r.eval_file_sha256) == ("may", True, F64)
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "a.json").write_text('{"n": 1, "deep": [{"utterance": "x"}]}')
    (tmp_path / "reports" / "b.json").write_text('{"n": 1, "text": "utt: no"}')
    assert [r.violation for r in files.report_violations(spark, f"{tmp_path}/reports").collect()] == ["row-level keys: utterance"]


def test_token_ids(spark):
    df = spark.createDataFrame([([[1, 2, 3]],)], "x array<array<int>>")
    assert df.select(datasets.token_ids(F.col("x"))).first()[0] == [1, 2, 3]
    for bad in ([[1], [2]], [], [[1, None]]):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], df.schema).select(datasets.token_ids(F.col("x"))).collect()


def test_models(spark, tmp_path):
    rows = [(str(i), f"{'guten tag' if i % 2 else 'good day'} {i}", "de" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string, lang string").withColumn("grams", ml.char_ngrams(F.col("text"), 1, 2))
    model = ml.fit_linear(df, "grams", "lang", 256)
    scored = model.transform(df)
    assert scored.where("prediction = _y").count() == 60
    # the vectors are the weights of tfidf()
    terms = model.stages[1].vocabulary
    want = {(r.id, r.term): r.weight for r in ml.tfidf(df, "id", "text", 1, 2).collect()}
    for r in scored.select("id", "_x").limit(5).collect():
        assert all(abs(want[r.id, terms[i]] - x) < 1e-9 for i, x in zip(r._x.indices.tolist(), r._x.values.tolist()))
    ml.save_model(model, f"{tmp_path}/m", {"train_sha256": E})
    assert ml.load_model(f"{tmp_path}/m", {"train_sha256": E}).transform(df).where("prediction = _y").count() == 60
    with pytest.raises(checks.ConstraintError):
        ml.load_model(f"{tmp_path}/m", {"train_sha256": F64})


def test_tagger(spark):
    rows = [(str(i), f"on may {i % 9} ok", [("date", 3, 8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, utt string, spans array<struct<type:string,start:int,end:int>>")
    model = ml.fit_bio(df, "utt", "spans", size=256)
    out = model.transform(ml.bio_features(df.limit(3), "utt", "id"))
    tags = model.stages[1].labels
    got = {}
    for r in out.collect():
        got.setdefault(r.id, {})[r.pos] = tags[int(r.prediction)]
    assert all([own[p] for p in sorted(own)] == ["O"] * 3 + ["B-date"] + ["I-date"] * 4 + ["O"] * 3 for own in got.values())


def test_first_by_group_in_a_stream(spark, tmp_path):
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 3, 3)]
    spark.createDataFrame(rows, "g string, s long, v long").selectExpr("g", "timestamp_seconds(s) AS at", "v").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("g string, at timestamp, v long").parquet(f"{tmp_path}/in")
    q = streaming.first_by_group(stream, "g", "at").writeStream.format("memory").queryName("first_rows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.g, r.v) for r in spark.table("first_rows").collect()} == {("a", 1), ("b", 3)}


@pytest.mark.parametrize("range_bytes", ["128m", "300"])
def test_line_numbers(spark, tmp_path, range_bytes):
    """Bad lines are named by file and line in files of several ranges, with blank lines, repeated lines and line ends of both kinds."""

    lines = []
    for i in range(120):
        lines.append("" if i % 13 == 5 else '{"id":1,' if i % 17 == 3 else '{"id":7,"t":"same"}' if i % 3 else f'{{"id":{i},"t":"é{"x" * (i % 40)}"}}')
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:40]), encoding="utf-8", newline="")
    (tmp_path / "empty.jsonl").write_text("")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, range_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [(r.file.rsplit("/", 1)[1], r.line, r.error is not None, r.id) for r in jsonl.scan_located(spark, str(tmp_path), spark.createDataFrame([], "id long, t string").schema).collect()]
        with pytest.raises(checks.ConstraintError, match=r"a\.jsonl:4, .*a\.jsonl:21"):
            jsonl.require_valid(jsonl.scan_located(spark, str(tmp_path), spark.createDataFrame([], "id long, t string").schema))
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(f, i + 1, x == '{"id":1,', None if x == '{"id":1,' else 7 if "same" in x else i) for f, own in (("a.jsonl", lines), ("b.jsonl", lines[:40])) for i, x in enumerate(own) if x]
    assert sorted((f, n, bad, None if bad else i) for f, n, bad, i in got) == sorted(want)
