"""Merkle manifests and prefix tries against plain recursive versions."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, registry, trie
from millrace.llm.common import Scratch


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _with_clashes(df):
    for name in ("tree", "idx", "n", "level", "item", "proof", "subroot", "root", "digest", "children", "block", "kind", "key", "pos", "part", "last", "bytes", "base", "own", "_run", "_tie"):
        df = df.withColumn(name, F.lit(1))
    return df


# --- op12 ---------------------------------------------------------------------------------

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def _leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def _tree(leaves):
    """The root, and for each leaf the pairs of joined siblings before and after it, from its own run up."""
    if len(leaves) == 1:
        return leaves[0], [[]]
    runs = [leaves[i : i + 3] for i in range(0, len(leaves), 3)]
    root, upper = _tree([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1 :])), *upper[i]] for i, r in enumerate(runs) for k in range(len(r))]


def plain_merkle(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(by[name], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        trees.append((own, *_tree([_leaf(r, r[4]) for r in own])))
    root, over = _tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, proofs), upper in zip(trees, over):
        for row, proof in zip(own, proofs):
            proof = proof + upper
            harmed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            folded = _leaf(row, row[4].replace("\n", "") if harmed else row[4])
            for left, right in proof:
                folded = sha(left + folded + right)
            out.append((row[0], _leaf(row, row[4]), subroot, root, sha("".join(a + b for a, b in proof)), folded, folded == root))
    return sorted(out, key=str)


def _documents(n, draw):
    rows = [(i, draw.choice(["hot", "hot", "hot", "b", "é", "", None, "漢"]), draw.choice(["en", None]), draw.choice([i, None]), draw.choice(["one\ntwo", "plain", None, "", "ça\n\n" * 3])) for i in range(n)]
    rows += [(n + 5, "alone", "en", 3, "x\ny"), (None, "b", None, None, None), (None, None, None, None, "z\n"), (-7, "b", "en", 1, "neg\n")]
    return rows + rows[:3] * 3 + [(3, "hot", "xx", 1, "same id\n"), (n + 9, "long", "en", 1, "many lines\n" * 200_000)]


def _save(spark, folder, rows):
    _with_clashes(spark.createDataFrame(rows, KIND).repartition(5)).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def _op12(spark, folder):
    got = registry.QUERIES["op12_merkle"](spark, folder)
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("per_range, stride", [(16_384, 7), (6, 2)])
def test_merkle(spark, tmp_path, monkeypatch, per_range, stride):
    """With ranges of six leaves and strides of two levels the frontier climbs in several rounds and proofs come down in several."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", per_range)
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rows = _documents(400, random.Random(3))
    folder = _save(spark, tmp_path, rows)
    got = _op12(spark, folder)
    assert got == plain_merkle(rows)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(db.sql(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({registry.ORACLES['op12_merkle']})").fetchall(), key=str)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 10])
def test_merkle_of_few(spark, tmp_path, n):
    rows = [(i, "only", "en", 1, f"text {i}\n") for i in range(n)]
    assert _op12(spark, _save(spark, tmp_path, rows)) == plain_merkle(rows)


def test_partial_parents_take_children_in_any_order(spark):
    """Nodes dealt to tasks at random give the same tree, through the frontier alone."""
    leaves = [sha(str(i)) for i in range(200)]
    nodes = spark.createDataFrame([("s", 200, 0, i, d) for i, d in enumerate(leaves)], "tree string, n long, level int, idx long, digest string").repartition(9, F.rand(1))
    with Scratch(spark) as scratch:
        got = merkle.grow(nodes, 1, scratch)
        assert [r.digest for r in got.where("root").collect()] == [_tree(leaves)[0]]
        assert got.count() == 67 + 23 + 8 + 3 + 1


def test_proofs_are_whole(spark):
    rows = [(i, f"s{i % 4}", sha(str(i)), f"more {i}") for i in range(50)]
    with Scratch(spark) as scratch:
        proven, root = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string, extra string"), scratch)
        got = proven.select("*", merkle.fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert sorted((r.doc_id, r.source, r.leaf, r.extra) for r in got) == rows
    assert {r.folded for r in got} == {root} and all(len(r.proof) == 3 + 2 for r in got)


# --- op13 ---------------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        path = tuple(own.get(c - base, [])[:h] + own[c][h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = [
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *sums[node], sha(",".join(map(str, sorted(ends.get(node, []))))))
        for node, m in members.items()
    ]
    return sorted(out, key=str)


def _conversations(draw):
    said = ["hello", "ça va?", "", None, "yes", "no", "漢字 " * 30]
    rows = []
    for c in [*range(-12, 60), 101, 102, 104, 2**40 + 1]:
        n = draw.choice([1, 1, 2, 3, 5, 8, 12, 14])
        rows += [(c, t if draw.random() > 0.1 else None, draw.choice(["user", "assistant", None]), draw.choice(said)) for t in range(n)]
    for c in range(200, 230):  # each one turn longer than the one before: chains on chains
        rows += [(c * 5, t, "user", f"step {t}") for t in range(c - 199)]
    rows += [(c * 5, 0, "user", "the same") for c in range(1000, 6200)]
    rows += [(None, 0, "user", "nobody"), (7, 3, "user", "twice"), (7, 3, "user", "twice"), (7, 3, "assistant", "tie"), (9000 * 5, 0, "user", "long " * 300_000), (9001 * 5, 0, "user", "long " * 300_000)]
    return rows


@pytest.mark.parametrize("fan", [64, 2])
def test_trie(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(trie, "FAN", fan)
    rows = _conversations(random.Random(8))
    _with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    names = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    found = sorted(map(tuple, got.select(*names).collect()), key=str)
    assert found == plain_trie(rows)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert found == sorted(db.sql(f"select {', '.join(names)} from ({registry.ORACLES['op13_prefix_trie']})").fetchall(), key=str)
