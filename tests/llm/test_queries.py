"""Every registered query through its own function, against versions that share no code with the operators."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, chat, langid, neardup_vectors, packing, registry, simhash, substrings
from millrace.llm.common import Scratch

tokenizers = pytest.importorskip("public_tokenizers")
TIK, JSON, PATTERN = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN
CLASH = ("digest", "word", "key", "ids", "fp", "score", "spans", "grp", "side", "rid", "root", "c0", "lo", "n", "h", "stays", "_digest", "_row", "_id", "_size", "_blocks", "held_out", "lang_pred")
WORDS = {"en": "the and of with this that from have house water", "de": "der und die nicht mit auf eine sich haus wasser", "fr": "le et les pas avec sur une est maison eau"}
RUN = "".join(random.Random(0).choice("abcdefghij") for _ in range(10_000))
LONG = ("some words 12 and a number, again.\n" * 60_000) + RUN + (" then it goes on, ça va?" * 130_000)
PEM = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("MIIEowIBAAKCAQEA" + "aB3/+" * 9 for _ in range(12)) + "\n-----END RSA PRIVATE KEY-----"


def _texts():
    draw = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "One TWO"), (5, "❤️"), (6, "1️⃣ 23"), (7, "́̂"), (8, "12 345 !!"), (8, "12 345 !!"), (9, "x<|endoftext|>y"), (10, "paſsword=abcdefgh password: 'abcdef12' API_KEY=xx.yy-zz"), (11, "AKIA" + "A1" * 9 + " " + "0af" * 9), (12, f"before {PEM} after"), (13, "é" * 40 + " toKen = " + "Z" * 30), (14, "漢字かな交じり文。" * 30)]
    for i in range(100, 220):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang].split()) for _ in range(draw.randint(1, 80)))))
    base = [draw.choice(WORDS["en"].split()) + str(draw.randint(0, 40)) for _ in range(250)]
    for i in range(300, 330):
        own = list(base)
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(["new", "other", "third"])
        rows.append((i, " ".join(own)))
    return rows + [(300, " ".join(base)), (300, " ".join(base))]


def _write(spark, folder, rows):
    lang = lambda i: None if i % 7 == 0 else next((k for k, w in WORDS.items() if 100 <= i < 220 and set((TEXT.get(i) or "").split()) <= set(w.split())), "en")
    df = spark.createDataFrame([(i, t, lang(i), f"src{i % 3}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASH:
        df = df.withColumn(name, F.lit(1))
    df.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


ROWS = _texts()
TEXT = dict(ROWS)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """Two documents of five megabytes with a run of 10,000 letters, and a short one."""
    return _write(spark, tmp_path_factory.mktemp("long"), [(1, LONG), (2, LONG), (3, "short")])


@pytest.fixture(scope="module")
def empty_table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def run(spark, name, folder):
    return registry.QUERIES[name](spark, folder).collect()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_table, name):
    rows = run(spark, name, empty_table)
    assert [r.conv_id for r in rows] == [-1] if name == "op9_chat" else rows == []


# --- op2, op4 ----------------------------------------------------------------------------


def _check_packing(rows, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in rows)
    want = []
    for i, t in texts:
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [0], 0
        while at < len(ids):
            left = len(ids) - at
            m = min(1024, 1 << (left.bit_length() - 1))
            want.append((i, at, m, zlib.crc32(np.array(ids[at : at + m], "<u4").tobytes()), len(ids)))
            at += m
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(want)


def test_op2(spark, table, long_table):
    _check_packing(run(spark, "op2_packing", table), ROWS)
    _check_packing(run(spark, "op2_packing", long_table), [(1, LONG), (2, LONG), (3, "short")])


def test_op4(spark, table, long_table):
    import base64

    import tiktoken

    with open(TIK, "rb") as file:
        ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in file}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(texts):
        own = {t: plain.encode_ordinary(t or "") for _, t in texts}
        return sorted((i, len(own[t]), sha(" ".join(map(str, own[t]))), sha(t or "")) for i, t in texts)

    for folder, texts in ((table, ROWS), (long_table, [(1, LONG), (2, LONG), (3, "short")])):
        assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op4_byte_bpe", folder)) == want(texts)


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x", "é one  two\n\n" + "\n" * 1_100_000 + "x <|endoftext|>  y", "q" + " \t" * 600_000])
def test_white_space_that_overflows_the_matcher(text):
    """A million and more code points of white space, against the tokenizer of the JSON file and by parts."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    assert packing._encode(JSON, PATTERN)(text) == plain.encode(text, add_special_tokens=False).ids
    ids = [i for piece in bpe.split_pieces(text, PATTERN) for i in bpe.encode_text(piece, TIK, PATTERN)]
    words = text.replace("<|endoftext|>", "end")
    assert ids == bpe.encode_text(text, TIK, PATTERN) and b"".join(bpe._token_bytes(TIK)[i] for i in ids).decode() == text
    assert packing._encode(JSON, PATTERN)(words) == plain.encode(words, add_special_tokens=False).ids


def test_one_match_at_a_time_gives_the_same_ids(monkeypatch):
    draw = random.Random(8)
    texts = ["".join(draw.choice(["a", "word", "'ll", " ", "  ", "\n", "é1", "?!", "漢", "\x1c", "\u3000", "<|endoftext|>"]) for _ in range(60)) + "   end" for _ in range(60)]
    want = [bpe.encode_text(x, TIK, PATTERN) for x in texts], [packing._encode(JSON, PATTERN)(x) for x in texts]
    monkeypatch.setattr(bpe, "SPACE", 2)
    assert all(map(bpe.long_space, texts)) and not bpe.long_space("a b\nc")
    assert ([bpe.encode_text(x, TIK, PATTERN) for x in texts], [packing._encode(JSON, PATTERN)(x) for x in texts]) == want


def test_chains_are_taken_up_again_behind_a_long_run():
    pieces = bpe.split_pieces(LONG, PATTERN)
    assert "".join(pieces) == LONG and max(map(len, pieces)) <= 2 * (bpe.CHUNK + bpe.OVERLAP)
    draw, whole = random.Random(8), bpe.encoder(TIK, PATTERN).encode_ordinary
    for _ in range(200):
        text = "".join(draw.choice(["a", "'ll", " ", "\n", "é1", "?!", "漢", "y" * draw.randint(1, 150)]) for _ in range(draw.randint(0, 200)))
        parts = bpe.split_pieces(text, PATTERN, chunk=40, overlap=20)
        assert "".join(parts) == text and [i for p in parts for i in whole(p)] == whole(text)


# --- op3 ---------------------------------------------------------------------------------


def _base_spans(text):
    """The contract's three kinds, written out."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_op3(spark, table, long_table):
    for folder, texts in ((table, ROWS), (long_table, [(1, LONG), (2, LONG), (3, "short")])):
        got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in run(spark, "op3_secrets", folder))
        want = []
        for i, t in texts:
            spans = _base_spans(t or "")
            want.append((i, *[sum(s[1] == k for s in spans) for k in range(3)], sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans))))
        assert got == sorted(want)
    spans = {r.doc_id: r.spans for r in run(spark, "op3_secrets", table)}
    assert f"private_key:7:{7 + len(PEM)}" in spans[12]


# --- op5 ---------------------------------------------------------------------------------


def plain_predict(model, text):
    """Softmax over averaged n-grams, byte by byte."""
    if not text or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    words = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip()
    data, total, n = f" {words} ".encode(), np.zeros(len(model.languages)), 0
    for size in (1, 2, 3, 4):
        for i in range(len(data) - size + 1):
            h = 0
            for b in data[i : i + size]:
                h = (h * 0x01000193 + b + 1) % 2**32
            total += model.table[h * 0x9E3779B1 % 2**32 >> 20]
            n += 1
    z = (total / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_op5(spark, table, long_table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    model = langid.fit_documents(docs)
    again = langid.fit_documents(docs.repartition(3))
    assert np.array_equal(model.table, again.table) and model.temperature == again.temperature
    rows = run(spark, "op5_language_id", table)
    assert len(rows) == len(ROWS)
    for r in rows:
        want, score = plain_predict(model, TEXT[r.doc_id])
        assert (r.lang_pred, r.held_out) == (want, zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert math.isclose(r.score, score, abs_tol=1e-4)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {0, 1, 2, 5, 6, 7, 8} and all(r.score == 0 for r in rows if r.doc_id in und)
    held = [r for r in rows if r.held_out and 100 <= r.doc_id < 220 and len(TEXT[r.doc_id].split()) > 5]
    assert sum(set(TEXT[r.doc_id].split()) <= set(WORDS[r.lang_pred].split()) for r in held) >= 0.95 * len(held)
    assert len({(r.lang_pred, r.score) for r in run(spark, "op5_language_id", long_table) if r.doc_id < 3}) == 1


def test_ties_go_to_the_first_language():
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2)), np.zeros(2), np.ones(1 << 16, bool), 1.0, 0.0, 0.0)
    assert model.predict("any") == ("aa", 0.5, False)


# --- op7 ---------------------------------------------------------------------------------


def _repeated(texts):
    count = {}
    for x in texts:
        for i in range(len(x) - 199):
            count[x[i : i + 200]] = count.get(x[i : i + 200], 0) + 1
    for x in texts:
        gone, spans = np.zeros(len(x) + 1, bool), 0
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(x) else 0
        yield len(x), int(gone.sum()), spans, sha(bytes(b for b, g in zip(x, gone) if not g))


@pytest.mark.parametrize("sizes", [{}, {"shard": 64, "hot": 3}])
def test_op7(spark, tmp_path, monkeypatch, sizes):
    draw = random.Random(7)
    base = "".join(draw.choice("abcdefgh é") for _ in range(900))
    rows = []
    for i in range(40):
        x = list(base[draw.randint(0, 300) : draw.randint(500, 900)])
        for _ in range(draw.randint(0, 4)):
            x[draw.randrange(len(x))] = f"#{draw.randint(0, 9)}"
        rows.append((i, "".join(x) + "".join(draw.choice("xyz ") for _ in range(draw.randint(0, 200)))))
    rows += [(100, None), (101, ""), (102, "a" * 199), (103, "a" * 200), (104, "a" * 201), (105, base), (105, base), (106, "For " * 300), (107, "For " * 60), (108, "".join(draw.choice("abc") for _ in range(60_000)) + base), (109, "\0" * 450 + base[:300])]
    folder = _write(spark, tmp_path, rows)
    spans = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda docs, scratch, least: spans(docs, scratch, least, **sizes))
    merges, put = [], Scratch.put

    def spy(self, df):
        out = put(self, df)
        if "merges" in df.columns:
            merges.append(out.agg(F.max("merges")).first()[0])
        return out

    monkeypatch.setattr(Scratch, "put", spy)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op7_suffix_array_dedup", folder))
    assert got == sorted((i, *x) for (i, _), x in zip(rows, _repeated([(t or "").encode() for _, t in rows])))
    assert merges and max(merges) >= 4  # levels that the registered query has merged


def test_copies_that_a_task_has_forgotten_leave_other_owners_room(monkeypatch):
    """A text that is read again gives the same owners; a passage of it in another text is still known by two."""
    monkeypatch.setattr(substrings, "SEEN", 0)
    draw = random.Random(5)
    said = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = said(1500)
    one, two = said(300) + passage, said(250) + passage + said(100)
    frames = list(substrings._anchor_rows(iter(pd.DataFrame({"text": [x]}) for x in (one, one, one, two)), 200))
    owners, given = {}, {}
    for f in frames:
        for r in f.itertuples():
            owners.setdefault((r.key, r.ctx), set()).add((r.digest, r.at))
            if r.word is not None:
                given.setdefault((r.key, r.ctx), set()).add((r.digest, r.at))
    both = [x for x, own in owners.items() if len(own) > 1]
    assert len(both) > 5 and all(len(given[x]) > 1 for x in both)


def test_suffix_family_is_sorted_and_geometric():
    draw = np.random.default_rng(4)
    family, seen = substrings.SuffixFamily(), {}
    for n in range(1, 9):
        words = draw.integers(97, 100, (50, 4), dtype=np.uint8)
        raw = np.array([bytes(x).ljust(substrings.WORD, b"-") for x in words])
        family.add(raw, np.arange(50), draw.integers(0, 3, 50), np.arange(50) + 50 * n)
        for w in raw.tolist():
            seen[w] = seen.get(w, 0) + 1
        assert [m for m, _ in family.levels] == [1 << b for b in range(3, -1, -1) if n >> b & 1]
        assert all((level.word[1:] >= level.word[:-1]).all() for _, level in family.levels)
    assert family.merges == 7
    whole = family.whole()
    assert {w: bool(h) for w, h in zip(whole.word.tolist(), whole.hit)} == {w: n > 1 for w, n in seen.items()}


# --- op8 ---------------------------------------------------------------------------------


def _classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8(spark, table, long_table):
    prints = [plain_fingerprint(t) for _, t in ROWS]
    root = _classes(len(ROWS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    low = {}
    for r, (i, _) in zip(root, ROWS):
        low[r] = min(low.get(r, i), i)
    want = sorted((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(ROWS, prints, root))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op8_simhash", table)) == want
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash", long_table)}
    assert got[1] == got[2] and got[1][1] == 1 and got[3][1] == 3


def test_full_buckets_are_split(spark):
    """Fingerprints that agree in a half: 900 in each of its buckets, compared in blocks of 50."""
    draw = random.Random(3)
    prints = sorted({0xABCDEF0100000000 | draw.getrandbits(10) << 7 for _ in range(900)})
    signed = [x - (1 << 64) for x in prints]
    with Scratch(spark) as scratch:
        links = simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch, block=50)
        parts = links.rdd.getNumPartitions()
        got = {(r.a, r.b) for r in links.collect()}
    assert parts > 1
    at = {x: i for i, x in enumerate(signed)}
    star = {(min(at[a], at[b]), max(at[a], at[b])) for a, b in got}
    assert _classes(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3) == _classes(len(prints), lambda i, j: (j, i) in star)


# --- the pipeline's stage of similar texts -----------------------------------------------


def plain_similar(texts, width=5, least=0.8):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() if t else []
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return _classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))


@pytest.mark.parametrize("block", [4096, 8])
def test_keep_one_by_similarity(spark, table, block):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    root = plain_similar([t for _, t in ROWS])
    first = {}
    for r, (i, t) in zip(root, ROWS):
        first[r] = min(first.get(r, (i, t)), (i, t), key=lambda x: x[0])
    kept = simhash.keep_one(docs, block=block)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in first.values())


def test_similar_texts_are_met():
    """Pairs at each similarity: how many share a one-wildcard piece and pass the bound on bits, as the docstring says."""
    draw = np.random.default_rng(5)
    for similarity, least in ((0.8, 0.95), (0.85, 0.98), (0.9, 0.99)):
        met = 0
        for _ in range(400):
            n, own = 900, draw.integers(0, 1 << 63, 1100, dtype=np.uint64)
            gone = round(n * (1 - similarity) / (1 + similarity))
            a, b = own[:n], np.concatenate([own[gone:n], own[n : n + gone]])
            x = simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)
            pieces = x.view(np.uint16)
            met += bool((np.bitwise_count(pieces) <= 1).any() and np.bitwise_count(x).sum() <= simhash.bits_apart(0.8))
        assert met >= least * 400


# --- op1, op10 ---------------------------------------------------------------------------


def _vectors(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, dims))[rng.integers(0, groups, n)] + rng.standard_normal((n, dims)) * 0.8


def _write_vectors(spark, folder, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    df.withColumn("label", F.lit(0)).withColumn("node", F.lit(1)).withColumn("grp", F.lit("x")).repartition(4).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_op1_recall_and_share(spark, tmp_path):
    shares = []
    for n in (2000, 12_000):
        v = _vectors(n, 24, 40, n)
        folder = _write_vectors(spark, tmp_path / str(n), list(enumerate(v)))
        got, looked = {}, []
        for r in run(spark, "op1_nn_descent", folder):
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
            looked.append(r.looked)
        hit = 0
        for q in range(0, n, 100):
            d = np.sqrt(((v - v[q]) ** 2).sum(1))
            d[q] = np.inf
            near = np.lexsort((np.arange(n), d))[:10]
            own = sorted(got[q])
            assert [r for r, *_ in own] == list(range(1, 11)) and all(math.isclose(s, d[i], rel_tol=1e-12) for _, i, s in own)
            hit += len(set(near.tolist()) & {i for _, i, _ in own})
        assert hit >= 0.9 * 10 * len(got) and len(got) == n // 100
        shares.append(np.mean(looked) / n)
    assert shares[1] < shares[0] / 2


def test_op1_odd_rows(spark, tmp_path):
    v = _vectors(400, 8, 5, 1)
    rows = [(i, list(x)) for i, x in enumerate(v)] + [(i, list(v[0])) for i in range(500, 530)] + [(300, list(v[300])), (600, None), (700, []), (800, [0.0] * 8), (900, [math.nan] * 8), (1000, [None] * 8), (1100, [1.0] * 3), (1200, [math.inf] + [1.0] * 7)]
    got = {}
    for r in run(spark, "op1_nn_descent", _write_vectors(spark, tmp_path, rows)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {0, 100, 200, 300, 500}
    assert [i for _, i, _ in sorted(got[0])] == list(range(500, 510)) and [i for _, i, _ in sorted(got[500])] == [0, *range(501, 510)]
    assert all(len({i for _, i, _ in own}) == 10 for own in got.values())


def test_guests_start_at_pivots(spark):
    v = _vectors(1500, 16, 30, 9)
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = _vectors(1500, 16, 30, 9)[:40] + 0.1
    guests = spark.createDataFrame([(10_000 + i, list(map(float, x))) for i, x in enumerate(asked)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, guests).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = [set(np.argsort(((v - q) ** 2).sum(1), kind="stable")[:10].tolist()) for q in asked]
    assert sum(len(got[10_000 + i] & w) for i, w in enumerate(want)) >= 0.95 * 400


def test_op10(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 64))
    rows = [(int(i), list(base[rng.integers(60)] + rng.standard_normal(64) * rng.choice([0, 0.1, 0.3, 0.45]))) for i in rng.permutation(800)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [math.nan] * 64), (9004, [None] * 64), (9005, [1.0] * 64), (9006, [2.0] * 64), (9007, [1.0] * 3), (9006, [2.0] * 64)]
    good = lambda v: v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = np.array([np.array(v) / np.linalg.norm(v) if good(v) else np.zeros(64) for _, v in rows])
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = _classes(len(rows), lambda i, j: link[i, j])
    low = {}
    for r, (i, _) in zip(root, rows):
        low[r] = min(low.get(r, i), i)
    want = sorted((i, int(link[k].sum()), low[root[k]], low[root[k]] == i) for k, (i, _) in enumerate(rows))
    got = run(spark, "op10_embedding_near_dedup", _write_vectors(spark, tmp_path, rows))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_op10_recall_at_fifty_thousand(spark):
    """Pairs at a cosine just over the threshold, hidden among 50,000 vectors."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((25_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((25_000, 64))
    y -= (x * y).sum(1)[:, None] * x
    y = 0.901 * x + math.sqrt(1 - 0.901**2) * y / np.linalg.norm(y, axis=1)[:, None]
    both = np.concatenate([x, y]).tolist()
    df = spark.createDataFrame(list(enumerate(both)), "vec_id long, embedding array<double>")
    got = neardup_vectors.near_duplicates(df)
    linked = got.where("vec_id >= 25000 and component_id = vec_id - 25000").count()
    assert linked >= 24_990  # under 4 in 10,000 missed; planned is 1
    assert got.where("n_links > 1").count() <= 5


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    turn = neardup_vectors.rotation(64, neardup_vectors.CODE_BITS)
    x = rng.standard_normal((600, 64))
    y = x + rng.standard_normal((600, 64)) * 0.5
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    signs, f = neardup_vectors.encode(x, turn)
    planes, low, step = neardup_vectors.quantise(y @ turn)
    about = neardup_vectors.estimate(neardup_vectors.words(signs), f, planes, low, step, turn.shape[1])
    error = about - x @ y.T
    near = np.diag(error)
    assert abs(near.mean()) < 0.01 and abs(error.mean()) < 0.005
    assert (np.abs(error) <= neardup_vectors.error_bound(f[:, None], turn.shape[1], step[None, :])).mean() > 0.99999


# --- op9 ---------------------------------------------------------------------------------


def test_op9(spark, tmp_path):
    draw = random.Random(6)
    said = ["</s>[INST] ok", "\\0<[", "", None, "plain", "[TURN]", "<s>[ROLE]user[/ROLE]"]
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), draw.choice(said)) for c in range(40) for t in range(draw.randint(1, 9))]
    rows += [(50, t, "assistant", "x" * 500_000) for t in range(4)] + [(51, 0, "user", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)).withColumn("turns", F.lit(1))
    df.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0], v[1], v[2], v[3] or "")):
        want.setdefault(c, []).append((r, x or ""))
    got = {r.conv_id: r for r in run(spark, "op9_chat", str(tmp_path))}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.OPEN and substrings.LEAST == 200
