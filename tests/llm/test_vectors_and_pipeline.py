"""Operators on vectors against brute force, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, langid, lines, neardup_vectors, packing, registry
from millrace.llm.common import local_components

KIND = "vec_id long, embedding array<double>"
ODD = [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] * 64), (9005, [1.0] * 64), (9006, [2.0] * 64), (9007, [1.0] * 3), (9008, [float("inf")] + [1.0] * 63)]


def _good(v):
    return v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [2048, 24])
def test_near_duplicates(spark, block):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 64))
    rows = [(int(i), list(map(float, base[rng.integers(40)] + rng.standard_normal(64) * rng.choice([0, 0.1, 0.3, 0.45])))) for i in rng.permutation(500)] + ODD
    df = spark.createDataFrame(rows, KIND).withColumn("cid", F.lit(1)).withColumn("label", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(df, block=block).collect()}
    unit = np.array([np.array(v) / np.linalg.norm(v) if _good(v) else np.zeros(64) for _, v in rows])
    a, b = np.nonzero(unit @ unit.T >= 0.9)
    a, b = a[a != b], b[a != b]
    root, n = local_components(a, b, len(rows)), np.bincount(a, minlength=len(rows))
    low = {}
    for r, (i, _) in zip(root, rows):
        low[r] = min(low.get(r, 1 << 60), i)
    assert got == {i: (int(c), low[r], low[r] == i) for (i, _), c, r in zip(rows, n, root)}


@pytest.mark.parametrize("n", [20_000, 1_000_000, 60_000_000])
def test_tables_miss_no_more_than_promised(n):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
    turn = neardup_vectors.rotation(64, neardup_vectors.CODE_BITS)
    same = (x @ turn > 0) == (y @ turn > 0)
    bits, tables = neardup_vectors.plan_tables(n, 0.9)
    agree = same.sum(1)
    one = np.prod([(agree - i) / (256 - i) for i in range(bits)], axis=0)
    assert ((1 - one) ** tables).mean() <= 1.1 * neardup_vectors.MISS


def test_near_duplicates_of_nothing(spark):
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    assert [r.n_links for r in neardup_vectors.near_duplicates(spark.createDataFrame(ODD[:5], KIND)).collect()] == [0] * 5


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    copy = list(map(float, rng.standard_normal(64)))
    rows = [(i, copy) for i in range(30)] + [(i, list(map(float, rng.standard_normal(64)))) for i in range(30, 600)] + ODD
    df = spark.createDataFrame(rows, KIND)
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), slice_rows=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, v) for i, v in rows if _good(v)]
    want = ann.brute_force([i for i, _ in good], np.array([v for _, v in good]), [i for i, _ in good if i % 100 == 0])
    assert got.keys() == want.keys()
    hit = 0
    for q, near in want.items():
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 11)) and [s for *_, s in own] == sorted(s for *_, s in own)
        assert all(abs(dict(near)[v] - s) < 1e-12 for _, v, s in own if v in dict(near))
        hit += len({v for v, _ in near} & {v for _, v, _ in own})
    assert hit >= 0.9 * 10 * len(want)
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11))  # ties go to the smaller id


def test_neighbours_in_groups(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 16))[np.arange(1200) % 60] + 0.05 * rng.standard_normal((1200, 16))
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], KIND)
    got = {}
    for r in ann.search(df, df.where("vec_id % 30 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = ann.brute_force(list(range(1200)), v, list(range(0, 1200, 30)))
    assert sum(len(got.get(i, set()) & {j for j, _ in near}) for i, near in want.items()) >= 0.95 * 10 * len(want)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0])], KIND)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()] == [(0, 1, 7), (0, 2, 100), (100, 1, 0), (100, 2, 7)]
    assert ann.search(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_parity(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.project(", ".join(columns)).fetchall()))


def _plain_kept(rows, model):
    from .test_queries import plain_similar

    first = {}
    for r, row in zip(plain_similar([r.text for r in rows]), rows):
        if r not in first or row.doc_id < first[r].doc_id:
            first[r] = row
    return {(r.doc_id, r.text) for r in first.values()}


def _plain_language(rows, model):
    """What has a letter, is like a language, and holds pairs of bytes that the sample has."""
    from .test_queries import plain_predict

    out = set()
    for r in rows:
        lang, score = plain_predict(model, r.text)
        if lang != "und":
            data = langid.letters(r.text).tobytes()
            known = np.mean([model.known[data[i] << 8 | data[i + 1]] for i in range(len(data) - 1)])
            if score >= model.least_score and known >= model.least_known:
                out.add((r.doc_id, r.text))
    return out


def _plain_redacted(rows, _):
    import re

    from .test_queries import _base_spans
    from .test_text_operators import plain_key_spans

    out = set()
    for r in rows:
        text = r.text
        holes = []
        for a, _, kind, b in _base_spans(text):
            if kind == "assign":
                a = b - len(re.search(r"[A-Za-z0-9+/_.=-]+$", text[a:b])[0])
                value = re.match(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", text[:b][_start(text, b) :], re.I | re.A)
                a = _start(text, b) + value.end()
            holes.append((a, b))
        holes += plain_key_spans(text)
        holes += [m.span() for m in re.finditer(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", text)]
        gone = np.zeros(len(text), bool)
        for a, b in holes:
            gone[a:b] = True
        out.add((r.doc_id, "".join(c for c, g in zip(text, gone) if not g)))
    return out


def _start(text, end):
    import re

    return max(m.start() for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if m.end() == end)


def _plain_lines(rows, _):
    from .test_text_operators import _plain_lines

    return set(_plain_lines([(r.doc_id, r.text, r.source) for r in rows]))


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version of its decision, on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(10**9, None, "en", "src0", 0), (10**9 + 1, "12 34", "en", "src0", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    plain = {"language_id": _plain_language, "line_dedup": _plain_lines, "near_duplicates": _plain_kept, "secret_scan": _plain_redacted}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        model = langid.fit_documents(docs) if name == "language_id" else None
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        kind, docs = docs.dtypes, spark.read.parquet(path)
        assert docs.dtypes == kind
        got = {(r.doc_id, r.text.replace("[REDACTED]", "") if name == "secret_scan" else r.text) for r in docs.collect()}
        assert got == plain[name](before, model), name
    from .test_queries import _check_packing

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _check_packing(packing.digest(corpus_pipeline.STAGES[-1][1](spark, docs, sf)).collect(), rows)
    assert corpus_pipeline.run(spark, sf).where("start = 0").count() == len(rows) - 0


def test_secret_stage_takes_whole_keys(spark, sf):
    """Keys in all their forms, one text of two megabytes among them, through the stage and against the redactor by lines."""
    from .test_text_operators import KEY_LINES, key_forms

    texts = [f"words before\n{f}\n\nwords after" for f in key_forms().values()] + ["some words here\n" * 120_000 + key_forms()["mail"] + "\n\nlast words", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.secret_scan(spark, docs, sf).select("doc_id", "text").collect())
    assert {(i, t.replace("[REDACTED]", "")) for i, t in got.items() if t} == _plain_redacted([r for r in docs.collect() if r.text], None) and (got[len(texts) - 2], got[len(texts) - 1]) == (None, "")
    assert not any(x[16:50] in t for t in got.values() if t for x in KEY_LINES)


def test_columns_that_clash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for name in ("_id", "_digest", "_stays", "_row", "_drop", "_host", "digest", "rejected", "spans", "ids"):
        docs = docs.withColumn(name, F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= 40


def test_pipeline_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
    assert lines.RATIO and packing.LENGTH == 1024


def test_each_query_walks_once_if_the_first_beam_suffices(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=(600, 12))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    walked, walk = [], ann.walk

    def counted(index, starts, *rest):
        walked.extend(r["query"] for r in starts.select("query").collect())
        return walk(index, starts, *rest)

    monkeypatch.setattr(ann, "walk", counted)
    monkeypatch.setattr(ann, "PROBES", 4)
    got = ann.search(df, df.where("vec_id % 30 = 0")).collect()
    assert len(got) == 20 * 10
    assert len(walked) == len(set(walked)) == 20
