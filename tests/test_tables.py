"""Checks, groups, draws, trees, statistics, readers and writers."""

import io
import hashlib
import json
import tarfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import hash_rank
from millrace.operators import checks, datasets, fingerprints, gates, groups, sampling, stats, tree
from millrace.sinks import jsonl as sink
from millrace.sources import archive, files, jsonl, manifests
from millrace.streaming import predictions as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_checks(spark):
    a = spark.createDataFrame([(1, "x", "train"), (1, "x", "dev"), (2, "y", "test"), (3, "z", "dev")], "id long, key string, part string")
    assert rows(checks.dup_keys(a, "id")) == [(1, 2)]
    assert rows(checks.key_mismatch(a, spark.createDataFrame([(1,), (9,)], "id long"), "id")) == [(2, 1)]
    assert rows(checks.split_leakage(a, "key", "part")) == [("dev", "train", 1)]
    assert rows(checks.count_mismatch(a, "part", {"train": 1, "dev": 3, "gone": 1})) == [("dev", 3, 2), ("gone", 1, 0), ("test", 0, 1)]
    assert rows(checks.not_subset(a.where("id > 1"), a.where("id = 2"), "key")) == [("z",)]
    with pytest.raises(checks.ConstraintError):
        checks.enforce(checks.dup_keys(a, "id"), "ids")
    checks.enforce(checks.dup_keys(a, "id", "part"), "ids")
    h = spark.createDataFrame([("a" * 64,), ("A" * 64,), ("b",), (None,)], "h string")
    assert [r[0] for r in h.select(checks.hex_digest("h")).collect()] == [True, False, False, False]
    assert rows(checks.order_mismatch(a.select(F.col("id").alias("o"), "key").where("id > 1"), a.select(F.col("id").alias("o"), F.lit("y").alias("key")).where("id > 1"), "o", "key")) == [(3, "z", "y")]


def test_groups(spark):
    s = "array<struct<type:string,value:string>>"
    df = spark.createDataFrame([("10", "k", [("a", "x"), ("b", "y")]), ("9", "k", [("b", "y"), ("a", "x")]), ("x1", "m", []), ("7", "m", [("a", "z")])], f"id string, key string, slots {s}")
    assert rows(groups.representative(df, "key", "id")) == [("k", "9", 2), ("m", "7", 2)]
    assert rows(groups.conflict_groups(df, "key", groups.slot_signature(F.col("slots")))) == [("m", 2, 2)]
    d = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "m", "a"), (4, "", "a")], "id long, key string, label string")
    got = groups.leakage_free(d, spark.createDataFrame([("m",)], "key string"), "key", "id", "label").collect()
    assert [(r.id, r.n_members, r.is_conflict) for r in got] == [(1, 2, True)]
    assert rows(groups.last_wins(d, "label", "id").select("id")) == [(2,), (4,)]


def test_draws_ignore_row_order(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7).cast("string").alias("scenario")).withColumn("rank", hash_rank(F.lit("s"), "key"))
    c = df.select("key", "rank", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("bucket"), F.lit("train").alias("split"))
    for make in (
        lambda x: sampling.natural_holdout(x, "rank", "key", [("a", 20), ("b", 10)]).select("key", "split", "ord"),
        lambda x: sampling.topk_per_bucket(x, ["scenario"], ["rank", "key"], 3).select("key", "rn"),
        lambda x: sampling.stratified_subset(x, "scenario", "rank", "key", 17).select("key"),
        lambda x: sampling.unique_take(x, "scenario", "key", "rank", 4, 7),
    ):
        assert rows(make(df)) == rows(make(df.repartition(7))) == rows(make(df.orderBy(F.desc("key"))))
    steps = [("train", "p", 30), ("train", "q", 30)]
    one = rows(sampling.quota_sample(c, steps))
    assert one == rows(sampling.quota_sample(c.repartition(5), steps)) and len({k for _, _, k, _ in one}) == 60
    assert rows(sampling.shortfall(df, df.select("scenario").union(spark.createDataFrame([("none",)], "scenario string")), "scenario", 72)) == [("3", 71), ("4", 71), ("5", 71), ("6", 71), ("none", 0)]


def test_tree(spark):
    m = [(f"m{i}", f"m{i - 1}" if i else None, "prompter" if i % 2 == 0 else "assistant", f" t{i} ", 0, True) for i in range(14)]
    m += [("orphan", "gone", "assistant", "x", 0, True), ("alt", "m0", "assistant", "other", 1, True), ("same", "m2", "assistant", "t3", 1, True), ("bad", "m12", "assistant", "x", 1, False)]
    df = spark.createDataFrame(m, "message_id string, parent_id string, role string, text string, rank int, ok boolean")
    c = {r.message_id: len(r.path) for r in tree.chains(df).collect()}
    assert c["m11"] == 12 and "m12" not in c and "orphan" not in c and c["alt"] == 2
    assert {r.message_id: r.n_turns for r in tree.sft_chains(df).collect()} == {f"m{i}": i + 1 for i in range(1, 12, 2)}
    assert [tuple(r) for r in tree.preference_pairs(df).collect()] == [("m0", "user: t0", "t1", "other")]
    a = spark.createDataFrame([("zh", True, False, False, "x"), ("zh", None, False, False, "x"), ("zh", True, None, False, "x"), ("zh", True, False, False, " 　"), ("en", True, False, False, "x")], "lang string, review_result boolean, deleted boolean, synthetic boolean, text string")
    assert [r[0] for r in a.select(tree.approved()).collect()] == [True, False, False, False, False]


def test_datasets(spark):
    df = spark.createDataFrame([("¿que tal", [], "0" * 64), ("?!", [], "0" * 64), ("x", [("date", "x")], "f" * 64)], "utt string, slots array<struct<type:string,value:string>>, h string")
    assert [r[0] for r in df.select(datasets.fallback_rejected(F.col("slots"), F.col("utt"), F.col("h"))).collect()] == ['{"slots":[{"type":"date","value":"que"}]}', None, '{"slots":[]}']
    c = spark.createDataFrame([("g", "short", [-0.4]), ("g", "long", [-0.3, -0.3])], "g string, label string, lp array<double>")
    got = {r.label: (r.rank_sum, r.rank_mean) for r in datasets.rank_candidates(c, "g", "label", "lp").collect()}
    assert got == {"short": (1, 2), "long": (2, 1)}
    pairs = spark.createDataFrame([(1, [("assistant", "a")]), (2, [("user", "a")])], "id long, chosen array<struct<role:string,content:string>>").withColumn("prompt", F.col("chosen"))
    assert datasets.matched_sft(pairs.where("id = 1"), "id").count() == 1
    with pytest.raises(PySparkException):
        datasets.matched_sft(pairs, "id").collect()


def test_statistics(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    r = stats.latency_summary(df, "v", ["g"]).first()
    assert (r.samples, r.p50, r.min, r.max, r.mean) == (10, 4.5, 0.0, 9.0, 4.5) and abs(r.p95 - 8.55) < 1e-9
    assert stats.order_statistic(df, ["g"], "v", lambda n: F.bround(0.9 * (n - 1)).cast("long"), "p90").first().p90 == 8.0
    c = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("cluster"), F.lit(1).cast("long").alias("tp"), F.col("id").alias("x"))
    got = rows(stats.dense_index(c, "cluster").select("idx", "cluster"))
    assert [k for _, k in got] == sorted(k for _, k in got) and [i for i, _ in got] == list(range(50))
    one, two = (rows(stats.cluster_draws(d, ["tp", "x"], 20, "s")) for d in (c, c.repartition(5)))
    assert one == two and all(n == 50 for _, n, _ in one) and len({x for *_, x in one}) > 1
    assert rows(stats.cluster_draws(c, ["x"], 20, "other")) != [(d, x) for d, _, x in one]


def test_fingerprints(spark):
    df = spark.range(2500).select("id", F.lit("p").alias("g"), F.col("id").cast("string").alias("t"))
    f = lambda d: fingerprints.dataset_fingerprint(d, "id", F.to_json(F.struct("id", "t")), "g").first()
    assert f(df) == f(df.repartition(7)) and f(df).n_rows == 2500
    assert f(df) != f(df.withColumn("t", F.when(F.col("id") == 7, "x").otherwise(F.col("t"))))


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    path = f"{tmp_path}/a.jsonl"
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"id":"é","n":1}\n\n{"id":"b","n":}\n')
    got = jsonl.scan(spark, path, schema).cache().collect()
    assert [(r.id, r.error) for r in got if r.id] == [("é", None)] and [r.error for r in got if r.error] == ['{"id":"b","n":}'] and got[0].file.endswith("a.jsonl")
    with pytest.raises((PySparkException, Py4JJavaError)):
        jsonl.scan_strict(spark, path, schema).collect()
    assert jsonl.blank_lines(spark, path).first().n == 1
    df = spark.createDataFrame([("x", 1), ("y", 2)], schema)
    out = f"{tmp_path}/out"
    assert sink.write_locked({out: df}, spark) == [out] and sink.write_locked({out: df.repartition(2)}, spark) == []
    with pytest.raises(FileExistsError):
        sink.write_locked({f"{tmp_path}/new": df, out: df.where("n = 1")}, spark)
    assert not (tmp_path / "new").exists()
    with pytest.raises(PySparkException):
        sink.write_jsonl(df, out)
    with pytest.raises(ValueError):
        sink.write_at_least(df, f"{tmp_path}/few", 3)
    with pytest.raises(ValueError):
        sink.confined("/a/../b", "/a")
    sink.write_manifest(df.agg(F.count(F.lit(1)).alias("n")), f"{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 2}
    ok = spark.createDataFrame([(1, "g", "raw")], "id long, group_sha256 string, raw_output string")
    assert sink.prediction_payload(ok, "e" * 64).first().eval_file_sha256 == "e" * 64
    with pytest.raises(PySparkException):
        sink.prediction_payload(ok.withColumn("raw_output", F.lit(None).cast("string")), "e").collect()


def test_archive(spark, tmp_path):
    path = f"{tmp_path}/a.tar"
    body = "".join(json.dumps({"id": str(i), "partition": p}) + "\n" for i, p in enumerate(("train", "dev", "test")))
    with tarfile.open(path, "w") as tar:
        for name, text in (("x/zh-CN.jsonl", body), ("x/LICENSE", "free"), ("x/en-US.jsonl", "{}")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "partition")])
    assert rows(archive.read(spark, path, schema, partitions=("train", "dev"))) == [("0", "train"), ("1", "dev")]
    assert bytes(archive.member_bytes(spark, path, "LICENSE").first().content) == b"free"
    with pytest.raises(PySparkException):
        archive.member_lines(spark, path, ".jsonl").collect()


def test_files(spark, tmp_path):
    for name, text in (("reports/a.json", '{"x":[{"utt":1}]}'), ("reports/b.json", '{"n":1}'), ("reports/c.json", "{"), ("models/m.pt", ""), ("big.txt", "x" * 1_100_000), (".env", "")):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = rows(files.release_tree_check(files.listing(spark, f"{tmp_path}/tree")))
    assert ("big.txt", "file over 1 MiB") in got and ("models/m.pt", "forbidden path") in got and (".env", "forbidden path") in got and len(got) == 3
    bad = {r.path.rsplit("/", 1)[1]: r.violation for r in files.report_violations(spark, f"{tmp_path}/tree/reports").collect()}
    assert bad == {"a.json": "row-level keys: utt", "c.json": "invalid JSON report"}
    d = files.directory_fingerprint(spark, f"{tmp_path}/tree/reports", "r", ("a.json",)).first().digests
    assert sorted(d) == ["r/a.json", "r/b.json", "r/c.json"]
    with pytest.raises(PySparkException):
        files.directory_fingerprint(spark, f"{tmp_path}/tree/reports", "r", ("z.json",)).collect()


def test_manifests(spark, tmp_path):
    h = ["a" * 64, "b" * 64]
    for name, layout, value in (
        ("n", manifests.NESTED, {"splits": {"dev": {"groups": [{"group_sha256": h[0]}, {"group_sha256": h[1]}], "source_ids": ["1"]}}}), ("s", manifests.BY_SPLIT, {"splits": {"dev": {"group_sha256": h}}}), ("f", manifests.FLAT, {"group_sha256": h}),
    ):
        (tmp_path / name).write_text(json.dumps(value, indent=2))
        assert sorted(r.group_sha256 for r in manifests.reserved_hashes(spark, f"{tmp_path}/{name}", layout).collect()) == h
    (tmp_path / "bad").write_text('{"group_sha256": ["zz"]}')
    with pytest.raises(PySparkException):
        manifests.reserved_hashes(spark, f"{tmp_path}/bad", manifests.FLAT).collect()
    opened = []
    with pytest.raises(ValueError):
        manifests.after_guard(lambda: (_ for _ in ()).throw(ValueError("locked")), lambda: opened.append(1))
    assert not opened


def test_requests(spark):
    bodies = ['{"text":" "}', '{"text":5}', '{"text":"a","x":1}', "{", json.dumps({"text": "x" * 21}), json.dumps({"text": "x" * 200}), '{"text":"ok"}']
    got = gates.triage_requests(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, body string"), "body").orderBy("i").collect()
    assert [(r.status, r.code) for r in got] == [(400, "empty_text"), (400, "invalid_request"), (400, "invalid_request"), (400, "invalid_request"), (413, "text_too_long"), (413, "body_too_large"), (200, "ok")]
    assert gates.latest(spark.createDataFrame([("c-9",), ("c-10",)], "p string"), "p").first().p == "c-10"


def test_stream(spark, tmp_path):
    gold = spark.createDataFrame([("1", "a b", [("date", "a")]), ("2", "c", [])], "id string, utt string, slots array<struct<type:string,value:string>>")
    (tmp_path / "in").mkdir()
    for i, raw in (("1", '{"slots":[{"type":"date","value":"a"}]}'), ("2", "{")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": i, "raw_output": raw}) + "\n")
    scores = stream.running_scores(stream.read_predictions(spark, f"{tmp_path}/in", 1), gold)
    q = scores.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("running").first()
    assert (r.n, r.n_exact, r.tp, r.fp, r.fn, r.micro_f1) == (2, 1, 1, 0, 0, 1.0)


def test_each_prediction_counts_once(spark, tmp_path):
    """Repeats, corrections and late versions, a batch that fails after its sums are written, and a restart."""
    utt, right = "a b c", '{"slots":[{"type":"date","value":"a"}]}'
    gold = spark.createDataFrame([(str(i), utt, [("date", "a")]) for i in range(6)], "id string, utt string, slots array<struct<type:string,value:string>>")
    parts = [
        [("0", right, 1), ("1", "{", 1), ("2", right, 2), ("9", right, 1), ("5", None, None)],
        [("0", right, 1), ("1", right, 2), ("2", "{", 1), ("3", '{"slots":[{"type":"time","value":"a"}]}', 1)],
        [("1", right, 2), ("3", right, 2), ("3", '{"slots":[]}', 3), ("4", right, 1), ("4", right, 1), ("5", right, 0)],
    ]
    place, sums, point = f"{tmp_path}/in", f"{tmp_path}/sums", f"{tmp_path}/point"
    (tmp_path / "in").mkdir()

    def arrive(i):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"id": a, "raw_output": b, "version": c}) + "\n" for a, b, c in parts[i]))

    def newest(upto):
        rows = {}
        for part in parts[:upto]:
            for key, raw, version in part:
                at = (-(1 << 63) if version is None else version, hashlib.sha256((raw or "").encode()).hexdigest())
                if int(key) < 6 and (key not in rows or at > rows[key][0]):
                    rows[key] = (at, raw)
        p = spark.createDataFrame([(k, r) for k, (_, r) in rows.items()], "id string, raw_output string")
        return stream.running_scores(p, gold).first().asDict()

    def kept():
        return stream.kept_scores(spark, sums).first().asDict()

    def arriving():
        return stream.read_predictions(spark, place, 1, stream.VERSIONED)

    arrive(0)
    stream.score_stream(arriving(), gold, sums, point).awaitTermination(120)
    assert kept() == newest(1)
    keep = stream.keep_changes(sums)

    def failing(batch, number):
        keep(batch, number)
        raise RuntimeError("lost")

    arrive(1)
    changes = stream.score_changes(arriving(), gold).writeStream.outputMode("update").foreachBatch(failing)
    with pytest.raises(Exception, match="lost"):
        changes.option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination(120)
    arrive(2)
    stream.score_stream(arriving(), gold, sums, point).awaitTermination(120)
    assert kept() == newest(3)
    assert kept()["n"] == 6 and kept()["n_exact"] == 5  # all but 3, whose newest is empty
