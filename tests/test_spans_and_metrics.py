"""Spans, tags, the strict parser and entity scores against plain versions on made-up rows."""

import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import keys, spans
from millrace.operators import evaluation, gates, metrics, ml
from millrace.plans import fixtures

SLOTS = "array<struct<type:string,value:string>>"


def slot(kind, value):
    return {"type": kind, "value": value}


def out(*slots):
    return json.dumps({"slots": list(slots)}, ensure_ascii=False, separators=(",", ":"))


ALPHABET = "abcdefg éß漢"


def words(draw, low=0, high=6):
    return ["".join(draw.choice(ALPHABET.replace(" ", "")) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(low, high))]


def marked(draw):
    """An utterance of words, its annotated form, and the spans that were put into it."""
    utt, annot, spans_ = "", "", []
    for w in words(draw, 1, 8):
        gap = draw.choice([" ", "", "  "]) if utt else ""
        utt, annot = utt + gap, annot + draw.choice([gap, gap + " "])
        if draw.random() < 0.4:
            kind = draw.choice([*spans.TARGET_TYPES, "song_name"])
            annot += f"[{kind}{draw.choice([' ', ''])}:{draw.choice([' ', ''])}{w}]"
            if kind != "song_name":
                spans_.append({"type": kind, "value": w, "start": len(utt), "end": len(utt) + len(w)})
        else:
            annot += w
        utt += w
    return utt, annot, spans_


def test_alignment_of_made_up_marks():
    draw = random.Random(21)
    for _ in range(500):
        utt, annot, want = marked(draw)
        assert spans.align_annotation(utt, annot) == want
        with pytest.raises(ValueError):
            spans.align_annotation(utt + "q", annot)
        if "[" in annot:
            for broken in (annot.replace("]", "", 1), annot.replace(":", "", 1)):
                with pytest.raises(ValueError):
                    spans.align_annotation(utt, broken)


@pytest.mark.parametrize(
    ("raw", "utt", "error"),
    [
        (out(slot("date", "friday")), "on friday", None), (out(), "x", None), (out(slot("date", "a"), slot("date", "a")), "a", None), (None, "x", "non_string_input"), ("x", None, "non_string_input"), ("{", "x", "invalid_json"), ('{"slots":[]} x', "x", "invalid_json"),
        ('{"slots":[],"slots":[]}', "x", "duplicate_json_key"), ('{"slots":[{"type":"date","type":"date","value":"x"}]}', "x", "duplicate_json_key"), ('{"other":[{"a":1,"a":2}]}', "x", "duplicate_json_key"),
        ("[]", "x", "invalid_top_level_schema"), ("NaN", "x", "invalid_top_level_schema"), ('{"slots":{}}', "x", "invalid_top_level_schema"), ('{"slots":[],"x":1}', "x", "invalid_top_level_schema"), ('{"slots":[1]}', "x", "invalid_slot_schema"),
        ('{"slots":[{"type":"date"}]}', "x", "invalid_slot_schema"), ('{"slots":[{"type":"date","value":1}]}', "x", "invalid_slot_type_or_value"), ('{"slots":[{"type":"song","value":"x"}]}', "x", "invalid_slot_type_or_value"), ('{"slots":[{"type":"date","value":" "}]}', " ", "invalid_slot_type_or_value"),
        (out(slot("date", "y")), "x", "value_not_copied_from_utterance"), ("[" * 100_000, "x", "invalid_json"), ('{"slots":' + "[" * 50_000 + "]" * 50_000 + "}", "x", "invalid_json"),
    ],
)
def test_strict_parser(raw, utt, error):
    got = spans.parse_output(raw, utt)
    assert got["error"] == error and (got["slots"] is None) == (error is not None)


def plain_tags(n, spans_):
    tags = ["O"] * n
    for kind, a, b in spans_:
        tags[a:b] = [f"B-{kind}"] + [f"I-{kind}"] * (b - a - 1)
    return tags


def plain_slots(utt, tags):
    """Runs of characters, left to right: an I- tag goes on with a run of its type, any other tag but O begins one."""
    out, open_ = [], None
    for c, t in zip(utt, tags):
        kind = t[2:]
        if t == "O":
            open_ = None
        elif t.startswith("I-") and open_ == kind:
            out[-1][1] += c
        else:
            out.append([kind, c])
            open_ = kind
    return [tuple(x) for x in out]


def _made_up_output(draw):
    pick = lambda *c: draw.choice(c)
    scalar = lambda: pick('"a"', '"date"', '" "', '"\\u0041b"', '"\\ud83d\\ude00"', '"\\ud800"', "1", "-0", "01", "1e5", "1.", "true", "null", "NaN", "-Infinity", '"漢"', '"x\\ty"', '"bad\\q"', '"tab\tx"', "{}", "[]", "[[1]]", '"\\u3000"', '"\u2003"', '"q\\"z"', '"{"')

    def flat():
        names = pick(["type", "value"], ["type", "value"], ["value", "type"], ["type"], ["type", "value", "x"], ["type", "type", "value"], [], ["ty\\u0070e", "value"])
        member = lambda n: f'"{n}"{pick("", "", " ")}:' + (pick('"date"', '"person"', scalar()) if n == "type" else pick('"a"', '"b c"', scalar()))
        return "{" + pick(",", ",", " , ", ",\n", ",,").join(map(member, names)) + "}"

    items = [flat() if draw.random() < 0.6 else out(slot(pick("date", "time"), pick("a", "b c", "é")))[10:-2] for _ in range(pick(0, 1, 1, 2, 3))]
    body = "[" + ",".join(items) + "]"
    text = '{"slots":' + body + "}"
    at = draw.randrange(len(text))
    return pick(
        text, text, text, text[:at] + text[at + 1 :], text[:at] + pick(*' "{}[],:\x01é') + text[at:], text[:at], pick(" ", "\n", "\xa0", "\ufeff", "`") + text + pick("", " ", "x", "\x0c"), scalar(), body, flat(),
        pick("", " ", '{"slots":{}}', '{"slots":[],"slots":[]}', text[:-1] + ',"x":1}', '{"slots":[],' + text[1:], '{"slots":[1]}', "hello", "[1,2]", "[,]", '{"a":{"b":1,"b":2}}', '{"slots":null}', '{"a":":[1]","a":2}', '{"a":1,":[1]":2,":[2]":[]}'),
    )


def test_parser_by_expressions(spark):
    """with_parsed gives what parse_output gives, also where it leaves an output to Python, and leaves few."""
    draw = random.Random(8)
    rows = [(i, draw.choice([None] + 30 * [_made_up_output(draw)]), draw.choice(["a b c é", "on a day \U0001f600 x\ty", "a", None])) for i in range(10_000)]
    rows += [(len(rows), "[" * 100_000, "x"), (len(rows) + 1, out(slot("date", "y" * 1_200_000)), "y" * 1_200_000), (len(rows) + 2, out(*[slot("date", "y")] * 20_000), "y")]
    got = spans.with_parsed(spark.createDataFrame(rows, "i int, raw string, utt string").repartition(4), "raw", "utt").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.p.asDict(True) == spans.parse_output(r.raw, r.utt), (r.raw[:200], r.utt[:50])
    left = spark.createDataFrame(rows, "i int, raw string, utt string").where(spans._settled(F.col("raw"), F.col("utt")).isNull()).count()
    assert left < 0.3 * len(rows)


def test_outputs_left_to_python(spark, sf):
    r = fixtures.raw_outputs(fixtures.utterances(spark, sf))
    assert r.where(spans._settled(F.col("raw_output"), F.col("utt")).isNull()).count() < 0.01 * r.count()


def test_tags_there_and_back(spark):
    draw = random.Random(5)
    rows = []
    for i in range(120):
        n = draw.randint(0, 14)
        cuts = sorted(draw.sample(range(n + 1), min(n + 1, 2 * draw.randint(0, 3))))
        own = [(draw.choice(spans.TARGET_TYPES), a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        loose = [draw.choice(["O", *[f"{p}-{k}" for p in "BI" for k in spans.TARGET_TYPES[:2]]]) for _ in range(n)]
        rows.append((str(i), "".join(draw.choice(ALPHABET) for _ in range(n)), own, loose))
    df = spark.createDataFrame(rows, "id string, utt string, spans array<struct<type:string,start:int,end:int>>, loose array<string>")
    tags = {r.id: r.tags for r in df.select("id", spans.bio_tags(F.col("utt"), F.col("spans")).alias("tags")).collect()}
    assert tags == {i: plain_tags(len(u), own) for i, u, own, _ in rows}
    got = {r.id: [(s.type, s.value) for s in r.slots] for r in spans.slots_from_bio(df, "id", "utt", "loose").collect()}
    assert got == {i: plain_slots(u, loose) for i, u, _, loose in rows}


def test_overlapping_and_far_spans_are_errors(spark):
    draw = random.Random(6)
    rows = [(str(i), "x" * 8, [("date", a, a + draw.randint(1, 4)) for a in sorted(draw.choices(range(9), k=draw.randint(1, 3)))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, utt string, spans array<struct<type:string,start:int,end:int>>")
    got = {r.id: r.bad for r in df.select("id", spans.span_errors(F.col("utt"), F.col("spans")).alias("bad")).collect()}
    assert got == {i: any(b > len(u) for _, _, b in own) or any(x[2] > y[1] for x, y in zip(own, own[1:])) for i, u, own in rows}


def test_viterbi_is_the_best_of_all_paths():
    draw = np.random.default_rng(9)
    classes = ["O", "B-x", "I-x", "B-y", "I-y"]
    legal = lambda p: all(t[0] != "I" or (i > 0 and p[i - 1] != "O" and p[i - 1][2:] == t[2:]) for i, t in enumerate(p))
    for n in (1, 2, 3, 4):
        paths = [p for p in itertools.product(classes, repeat=n) if legal(p)]
        for _ in range(60):
            scores = draw.integers(-4, 5, (n, len(classes))).astype(float)
            value = lambda p: sum(scores[i, classes.index(t)] for i, t in enumerate(p))
            got = tuple(ml.viterbi(scores, classes))
            assert got in paths and value(got) == max(map(value, paths))
    assert ml.viterbi(np.zeros((0, 5)), classes) == []


def plain_flags(gold, pred, parsed):
    """The error flags of one row, counted slot by slot."""
    valid, p = pred is not None, pred or []
    g, q = Counter(gold), Counter(p)
    tp, exact = sum((g & q).values()), pred is not None and g == q
    gr, pr = list((g - q)), list((q - g))
    pairs = [(a, b) for a in gr for b in pr] if valid else []
    return {
        "fully_correct": exact, "incorrect": not exact, "invalid_json": not parsed["json_valid"], "invalid_schema": parsed["json_valid"] and not parsed["schema_valid"], "invalid_copy": parsed["schema_valid"] and not parsed["copy_valid"],
        "missed_all_gold_slots": bool(gold) and tp == 0, "missed_all_gold_slots_valid_output": valid and bool(gold) and tp == 0, "extra_slots_on_gold_empty": valid and not gold and bool(p), "partial_correct": valid and tp > 0 and not exact,
        "type_confusion_same_value": any(a[1] == b[1] and a[0] != b[0] for a, b in pairs), "same_type_different_value": any(a[0] == b[0] and a[1] != b[1] for a, b in pairs),
        "possible_span_boundary_mismatch": any(a[0] == b[0] and a[1] != b[1] and (a[1] in b[1] or b[1] in a[1]) for a, b in pairs),
        "duplicate_slot_output": valid and len(q) < len(p), "excess_duplicate_slot": valid and any(n > max(1, g[s]) for s, n in q.items()),
    }


@pytest.fixture(scope="module")
def scored(spark):
    """Random gold slots, and outputs that keep, change, repeat or break them."""
    draw = random.Random(13)
    rows = []
    for i in range(250):
        w = words(draw, 1, 6)
        pick = lambda: (draw.choice(spans.TARGET_TYPES[:2]), draw.choice(w)[: draw.randint(1, 4)])
        gold = [pick() for _ in range(draw.randint(0, 3))]
        pred = [x for x in gold if draw.random() < 0.7] + [pick() for _ in range(draw.choice([0, 0, 1, 2]))]
        pred += draw.choices(pred, k=1) if pred and draw.random() < 0.2 else []
        raw = out(*[slot(*x) for x in pred])
        raw = draw.choice([raw] * 6 + [raw[:-1], '{"slots":1}', raw.replace('"value":"', '"value":"#', 1)])
        rows.append((str(i), " ".join(w), [slot(*x) for x in gold], raw))
    df = spark.createDataFrame(rows, f"id string, utt string, slots {SLOTS}, raw string")
    return rows, df.withColumn("p", spans.parse_outputs("raw", "utt")).withColumn("pred", F.col("p.slots")).persist()


def _plain_rows(rows):
    for i, utt, gold, raw in rows:
        parsed = spans.parse_output(raw, utt)
        yield i, [(s["type"], s["value"]) for s in gold], None if parsed["slots"] is None else [(s["type"], s["value"]) for s in parsed["slots"]], parsed


def test_taxonomy_by_counting(scored):
    rows, df = scored
    got = {r.id: r for r in metrics.taxonomy_flags(df, "slots", "pred", "p", "id").collect()}
    total, n_has = Counter(), 0
    for i, gold, pred, parsed in _plain_rows(rows):
        want = plain_flags(gold, pred, parsed)
        assert {c: got[i][c] for c in metrics.CATEGORIES} == want
        total.update(c for c, v in want.items() if v)
        n_has += bool(gold)
    for r in metrics.taxonomy(metrics.taxonomy_flags(df, "slots", "pred", "p", "id")).collect():
        base = n_has if r.category.startswith("missed") else len(rows) - n_has if r.category.startswith("extra") else len(rows)
        assert (r.n, r.denominator) == (total[r.category], base) and math.isclose(r.rate, total[r.category] / base)
    none = metrics.taxonomy(metrics.taxonomy_flags(df.where("size(slots) > 0"), "slots", "pred", "p", "id")).where("category = 'extra_slots_on_gold_empty'").first()
    assert none.rate is None


def test_entity_scores_by_counting(scored):
    rows, df = scored
    tp = fp = fn = exact = invalid = 0
    by = {t: [0, 0, 0] for t in spans.TARGET_TYPES}
    for _, gold, pred, _ in _plain_rows(rows):
        g, q = Counter(gold), Counter(pred or [])
        for k, part in enumerate((g & q, q - g, g - q)):
            for (t, _), n in part.items():
                by[t][k] += n
        exact += pred is not None and g == q
        invalid += pred is None
    tp, fp, fn = (sum(x[k] for x in by.values()) for k in range(3))
    counts = metrics.entity_counts(df, "slots", "pred", "id")
    r = metrics.entity_prf(counts).first()
    assert (r.n, r.tp, r.fp, r.fn, r.n_exact, r.n_invalid) == (len(rows), tp, fp, fn, exact, invalid)
    assert math.isclose(r.micro_f1, 2 * tp / (2 * tp + fp + fn))
    types = {x.type: ([x.tp, x.fp, x.fn], x.f1) for x in metrics.entity_prf_by_type(counts).collect()}
    f1 = {t: 2 * a / (2 * a + b + c) if a + b + c else None for t, (a, b, c) in by.items()}
    assert {t: c for t, (c, _) in types.items()} == by and all((v is None) == (f1[t] is None) and math.isclose(v or 0, f1[t] or 0) for t, (_, v) in types.items())
    assert math.isclose(evaluation.macro_f1(metrics.entity_prf_by_type(counts)).first().macro_f1, sum(x or 0 for x in f1.values()) / 4, abs_tol=1e-8)


def test_entity_scores(spark):
    d = lambda v: slot("date", v)
    rows = [("1", [d("a"), d("a")], [d("a"), d("a")]), ("2", [d("b"), d("c")], [d("b")]), ("3", [d("x")], None), ("4", [], None)]
    df = spark.createDataFrame(rows, f"id string, slots {SLOTS}, pred {SLOTS}")
    counts = metrics.entity_counts(df, "slots", "pred", "id")
    r = metrics.entity_prf(counts).first()
    assert (r.tp, r.fp, r.fn, r.micro_f1, r.n_exact, r.n_no_slot_invalid, r.n_invalid) == (3, 0, 2, 0.75, 1, 1, 2)
    by = {x.type: (x.tp, x.f1) for x in metrics.entity_prf_by_type(counts).collect()}
    assert by == {"date": (3, 0.75), "time": (0, None), "place_name": (0, None), "person": (0, None)}
    assert metrics.entity_prf(counts.where("n_gold = 0")).first().micro_f1 is None


def test_classification(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), ("b", "zzz")]
    counts = metrics.confusion(spark.createDataFrame(rows, "gold string, pred string"), "gold", "pred")
    r = metrics.classification_score(counts).first()
    assert (r.n, r.n_correct, r.n_valid, r.n_unknown, r.n_invalid, r.accuracy) == (5, 2, 3, 1, 1, 0.4)
    assert math.isclose(r.macro_f1, (2 / 3 + 2 / 5) / 2, abs_tol=1e-9)
    assert {(x.gold, x.pred, x.n) for x in metrics.errors_of(counts).collect()} == {("a", "b", 1), ("b", "<INVALID>", 1), ("b", "zzz", 1)}


@pytest.mark.parametrize(
    ("new", "logprob", "replaced"),
    [(out(slot("date", "a")), -0.08, True), (out(slot("date", "a")), -0.08001, False), (out(slot("date", "a")), None, False), (out(slot("date", "a")), float("nan"), False), (out(), 0.0, False), (out(slot("date", "z")), 0.0, False), ("{", 0.0, False)],
)
def test_hybrid(spark, new, logprob, replaced):
    df = spark.createDataFrame([("a b", "old", new, logprob)], "utt string, old string, new string, lp double").withColumn("p", spans.parse_outputs("new", "utt"))
    r = ml.choose_hybrid(df, "old", "new", "p", "lp").first()
    assert (r.replaced, r.chosen) == (replaced, new if replaced else "old")


def test_keys(spark):
    assert keys.exact_key("Ｘ Y z", "weak") == keys.exact_key("xyZ", "weak")
    assert keys.exact_key("Straße, ¥5!", "strong") == "strasse¥5" and keys.exact_key("a_b ¥5", "alnum") == "ab5"
    df = spark.createDataFrame([("Straße, Ok ¥5!",), ("a　b\x1cc",), ("",), (None,)], "t string")
    # NFKC makes a plain blank of the ideographic one, which only the key that keeps blanks shows
    assert {kind: keys.native_is_exact(df, "t", kind).first().n_different for kind in keys.KINDS} == {"weak": 0, "strong": 0, "alnum": 0, "model": 1}


def test_gates(spark):
    cols = "json_valid_rate double, schema_valid_rate double, copy_valid_rate double, micro_f1 double, positive_f1 double, n_no_slot_failure long, n_no_slot long, delta_low double, reduction_low double, system string, step long"
    df = spark.createDataFrame([(0.95, 0.95, 0.95 - 1e-13, 0.6, 0.6, 3, 10, 0.01, 0.01, "a", 1), (1.0, 1.0, 1.0, None, 0.7, 4, 10, None, 0.0, "b", 2)], cols)
    got = {(r.system, r.gate): r.gate_passed for r in gates.gate_checks(df, "system").collect()}
    assert got["a", "v2"] and not got["a", "v3"] and not got["a", "v5"] and got["a", "v2_confirmation"]
    assert not any(v for (s, _), v in got.items() if s == "b")
    assert gates.choose_checkpoint(df).first().system == "a" and gates.choose_checkpoint(df.where("step = 2")).count() == 0
