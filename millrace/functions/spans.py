"""Annotated spans, BIO tags and model outputs.

Schemas: a slot is struct<type, value>; a span has start and end too (code points, end exclusive).
The span aligner is an Arrow UDF. The strict parser is made of expressions for all outputs whose grammar a
regular expression can settle; what that leaves open (deeper nesting, escaped keys, numbers that aren't finite) goes to an
Arrow UDF.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import once

#: Fixed values.
TARGET_TYPES = ("date", "time", "place_name", "person")
ANNOTATION = r"\[\s*([A-Za-z_]+)\s*:\s*([^\[\]]+?)\]"

SLOT = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
SLOTS = T.ArrayType(SLOT)
SPAN = T.StructType([*SLOT.fields, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PARSED = T.StructType(
    [
        T.StructField("slots", SLOTS),
        T.StructField("json_valid", T.BooleanType()),
        T.StructField("schema_valid", T.BooleanType()),
        T.StructField("copy_valid", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def canonical_json(slots: Column) -> Column:
    """Compact JSON with the single key slots, type before value."""
    return F.to_json(F.struct(F.transform(slots, lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))).alias("slots")))


class _Pairs(list):
    """A JSON object as its pairs, in order and with repetitions."""


def _repeats(value: object) -> bool:
    if isinstance(value, _Pairs):
        return len({k for k, _ in value}) < len(value) or any(_repeats(v) for _, v in value)
    return isinstance(value, list) and any(map(_repeats, value))


def _slot_error(slot: object) -> str | None:
    if not isinstance(slot, _Pairs) or {k for k, _ in slot} != {"type", "value"}:
        return "invalid_slot_schema"
    kind, value = dict(slot)["type"], dict(slot)["value"]
    fine = isinstance(kind, str) and kind in TARGET_TYPES and isinstance(value, str) and value.strip()
    return None if fine else "invalid_slot_type_or_value"


def parse_output(raw: object, utterance: object) -> dict:
    """Strict reading of one model output; the first check that fails names the error."""
    stages = ("json_valid", "schema_valid", "copy_valid")
    result = lambda passed, error=None, slots=None: {"slots": slots, **{s: i < passed for i, s in enumerate(stages)}, "error": error}
    if not isinstance(raw, str) or not isinstance(utterance, str):
        return result(0, "non_string_input")
    try:
        tree = json.loads(raw, object_pairs_hook=_Pairs)
        repeated = _repeats(tree)
    except (ValueError, RecursionError):  # nested too deeply to be read
        return result(0, "invalid_json")
    if repeated:
        return result(1, "duplicate_json_key")
    if not isinstance(tree, _Pairs) or [k for k, _ in tree] != ["slots"] or type(tree[0][1]) is not list:
        return result(1, "invalid_top_level_schema")
    slots = tree[0][1]
    for error in map(_slot_error, slots):
        if error:
            return result(1, error)
    slots = [dict(s) for s in slots]
    if not all(s["value"] in utterance for s in slots):
        return result(2, "value_not_copied_from_utterance")
    return result(3, None, slots)


@F.pandas_udf(PARSED)
def _parse_rest(raw: pd.Series, utterance: pd.Series) -> pd.DataFrame:
    """``parse_output`` of the rows that are given; the others are null and stay so."""
    given = raw.notna().to_numpy() & utterance.notna().to_numpy()
    columns = {name: np.full(len(raw), None, dtype=object) for name in PARSED.names}
    for i in np.flatnonzero(given):
        for name, value in parse_output(raw.iloc[i], utterance.iloc[i]).items():
            columns[name][i] = value
    return pd.DataFrame(columns)


# The grammar of JSON as possessive patterns, which neither backtrack nor recurse. A string of ``_TEXT`` holds no escaped surrogates,
# ``_NAME`` no escapes at all, ``_ANY_TEXT`` is any string.
_W = r"[ \t\n\r]*+"
_PLAIN = r'[^"\\\x00-\x1f]*+'
_NAME = f'"{_PLAIN}"'
_ESCAPED = rf'"{_PLAIN}(?:\\(?:["\\/bfnrt]|u%s[0-9a-fA-F]{{4}}){_PLAIN})*+"'
_TEXT, _ANY_TEXT = _ESCAPED % "(?![dD][89a-fA-F])", _ESCAPED % ""
_NUMBER = r"-?+(?:0|[1-9][0-9]{0,300}+)(?:\.[0-9]{1,300}+)?+(?:[eE][+-]?+[0-9]{1,300}+)?+"
_SCALAR = f"(?:{_TEXT}|{_NUMBER}|true|false|null)"
_MEMBER = f"{_NAME}{_W}:{_W}{_SCALAR}"


def _listed(item: str, begin: str, end: str) -> str:
    return rf"\{begin}{_W}(?:{item}{_W}(?:,{_W}{item}{_W})*+)?+\{end}"


_FLAT = _listed(_MEMBER, "{", "}")
_LIST = _listed(f"(?:{_SCALAR}|{_FLAT})", "[", "]")
_WIDE_MEMBER = f"({_NAME}){_W}:{_W}(?:{_SCALAR}|{_FLAT}|{_LIST})"
_SLOT_LIST = rf'\A{_W}\{{{_W}"slots"{_W}:{_W}{_listed(_FLAT, "[", "]")}{_W}\}}{_W}\z'
_ONLY_SLOTS = rf'\A{_W}\{{{_W}"slots"{_W}:{_W}{_LIST}{_W}\}}{_W}\z'
_OTHER = rf"\A{_W}(?:{_SCALAR}|{_LIST}|{_listed(_WIDE_MEMBER, '{', '}')}){_W}\z"
#: Characters of JSON outside its strings, and what can't stand there side by side.
_NOT_JSON = r"[^ \t\n\r{}\[\]:,0-9+\-.eEtrufalsnNIiy]|[,:][ \t\n\r]*+(?:[}\],:]|\z)|[\[{][ \t\n\r]*+[,:]|\A[ \t\n\r]*+\z"
#: White space as Python's ``str.strip`` takes it.
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0  -     　]*+"
_BLANK = rf"\A{_SPACES}\z"
#: A slot as it should be, and a list of such.
_GOOD_SLOT = rf'\{{{_W}"type"{_W}:{_W}"({"|".join(TARGET_TYPES)})"{_W},{_W}"value"{_W}:{_W}"(?!{_SPACES}")({_PLAIN})"{_W}\}}'
_GOOD_SLOTS = rf'\A{_W}\{{{_W}"slots"{_W}:{_W}{_listed(_GOOD_SLOT, "[", "]")}{_W}\}}{_W}\z'
#: Longer outputs are left to Python: a test with outputs of 100,000 and 600,000 characters did not end in four minutes by expressions.
_LONGEST = 10_000


def _settled(raw: Column, utterance: Column) -> Column:
    """``parse_output`` by expressions; null where they can't tell."""
    extract = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    result = lambda passed, error, slots=None: F.struct(
        (F.lit(None).cast(SLOTS) if slots is None else slots).alias("slots"),
        *[F.lit(i < passed).alias(s) for i, s in enumerate(("json_valid", "schema_valid", "copy_valid"))],
        F.lit(error).cast("string").alias("error"),
    )
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (evaluates value once)
    repeats = lambda names: F.size(F.array_distinct(names)) < F.size(names)
    names = lambda flat: extract(flat, f"({_NAME}){_W}:{_W}{_SCALAR}", 1)
    flats = extract(raw, _FLAT, 0)

    bare = F.regexp_replace(raw, F.lit(_ANY_TEXT), F.lit("0"))
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark)))
    broken = lambda b: b.rlike(_NOT_JSON) | (count(b, "{") != count(b, "}")) | (count(b, "[") != count(b, "]"))

    copied = lambda values: F.forall(values, lambda v: F.contains(utterance, v))
    types, values = (extract(raw, _GOOD_SLOT, i) for i in (1, 2))
    good = F.when(copied(values), result(3, None, F.zip_with(types, values, lambda t, v: F.struct(t.alias("type"), v.alias("value"))))).otherwise(result(2, "value_not_copied_from_utterance"))

    # a quoted name or text without escapes is read off; from_json, which is slower, decodes the others
    inner = lambda flat, name: F.regexp_extract(flat, f'"{name}"{_W}:{_W}"({_PLAIN})"', 1).alias(name)
    plain = F.transform(flats, lambda flat: F.struct(inner(flat, "type"), inner(flat, "value")))
    decoded = F.when(F.contains(raw, F.lit("\\")), F.from_json(raw, T.StructType([T.StructField("slots", SLOTS)]))["slots"]).otherwise(plain)

    def error(flat, slot):
        pair = F.array_sort(names(flat)) == F.array(F.lit('"type"'), F.lit('"value"'))
        texts = F.size(extract(flat, f"{_NAME}{_W}:{_W}{_TEXT}", 0)) == 2
        fine = texts & slot["type"].isin(*TARGET_TYPES) & ~slot["value"].rlike(_BLANK)
        return F.when(~pair, "invalid_slot_schema").when(~F.coalesce(fine, F.lit(False)), "invalid_slot_type_or_value")

    def judged(x):
        found = F.array_compact(F.zip_with(x["flats"], x["slots"], error))
        settled = F.when(copied(F.transform(x["slots"], lambda s: s["value"])), result(3, None, x["slots"])).otherwise(result(2, "value_not_copied_from_utterance"))
        named = lambda e: F.when(e.isNull(), settled).when(e == "invalid_slot_schema", result(1, "invalid_slot_schema")).otherwise(result(1, "invalid_slot_type_or_value"))
        return F.when(F.exists(x["flats"], lambda f: repeats(names(f))), result(1, "duplicate_json_key")).otherwise(once(F.get(found, F.lit(0)), named))

    # no brace inside a string: then what looks like an object is one
    clear = lambda b: count(raw, "{") == count(b, "{")
    repeated = (raw.rlike(rf"\A{_W}\{{") & repeats(extract(raw, _WIDE_MEMBER, 1))) | F.exists(flats, lambda f: repeats(names(f)))
    other = F.when(repeated, result(1, "duplicate_json_key")).when(~raw.rlike(_ONLY_SLOTS), result(1, "invalid_top_level_schema"))
    return (
        F.when(raw.isNull() | utterance.isNull(), result(0, "non_string_input"))
        .when(F.length(raw) > _LONGEST, F.lit(None).cast(PARSED))
        .when(raw.rlike(_GOOD_SLOTS), good)
        .when(raw.rlike(_SLOT_LIST), once(F.struct(flats.alias("flats"), decoded.alias("slots")), judged))
        .otherwise(once(bare, lambda b: F.when(broken(b), result(0, "invalid_json")).when(clear(b) & raw.rlike(_OTHER), other)))
    )


def with_parsed(df: DataFrame, raw: str, utterance: str, name: str = "p") -> DataFrame:
    """The rows with ``parse_output`` as a column of ``PARSED``. Expressions settle what they can; only the rest reaches Python,
    nulls go in place of the others."""
    given = F.when(F.col("_settled").isNull(), F.col(raw))
    rest = _parse_rest(given, F.when(given.isNotNull(), F.col(utterance)))
    settled = once(df, _settled=_settled(F.col(raw), F.col(utterance)))
    return once(settled, **{name: F.coalesce("_settled", rest)}).drop("_settled")


@F.pandas_udf(PARSED)
def parse_outputs(raw: pd.Series, utterance: pd.Series) -> pd.DataFrame:
    """``parse_output`` of all rows, for where only a column will do."""
    return pd.DataFrame([parse_output(a, b) for a, b in zip(raw, utterance)], columns=PARSED.names)


def align_annotation(utterance: str | None, annotated: str | None, types: tuple[str, ...] = TARGET_TYPES) -> list[dict]:
    """Spans of the marked values of the given types in the utterance.

    The two texts are matched by their sequences of characters other than white space. Raises ValueError for
    empty input, leftover markers, values without characters and texts that don't match.
    """
    if not utterance or not annotated:
        raise ValueError("utterance and annotation must be non-empty strings")
    solid = [i for i, c in enumerate(utterance) if not c.isspace()]
    bare = lambda s: "".join(s.split())
    rest = re.sub(ANNOTATION, "", annotated)
    if "[" in rest or "]" in rest:
        raise ValueError("unparsed annotation marker")
    if bare(re.sub(ANNOTATION, lambda m: m[2], annotated)) != "".join(utterance[i] for i in solid):
        raise ValueError("annotation doesn't match the utterance")
    spans, place, last = [], 0, 0
    for m in re.finditer(ANNOTATION, annotated):
        place += len(bare(annotated[last : m.start()]))
        width, last = len(bare(m[2])), m.end()
        if not width:
            raise ValueError("empty annotated slot")
        if m[1] in types:
            start, end = solid[place], solid[place + width - 1] + 1
            spans.append({"type": m[1], "value": utterance[start:end], "start": start, "end": end})
        place += width
    return spans


@F.pandas_udf(T.ArrayType(SPAN))
def align_annotations(utterance: pd.Series, annotated: pd.Series) -> pd.Series:
    return pd.Series([align_annotation(a, b) for a, b in zip(utterance, annotated)], dtype=object)


def annotation_types(annotated: Column) -> Column:
    return F.regexp_extract_all(annotated, F.lit(ANNOTATION), F.lit(1))


def annotation_values(annotated: Column) -> Column:
    return F.regexp_extract_all(annotated, F.lit(ANNOTATION), F.lit(2))


def bio_tags(utterance: Column, spans: Column) -> Column:
    """One tag a character. Spans mustn't overlap or leave the text: see ``span_errors``.

    Runs of equal tags are repeated as a whole; only the tags of spans that break the rule are looked up at each character."""

    def tag(i):
        own = F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"])), F.lit(0))
        return F.when(own.isNull(), F.lit("O")).otherwise(F.concat(F.when(own["start"] == i, F.lit("B-")).otherwise(F.lit("I-")), own["type"]))

    # each span with the end of the one before, and null with the last end
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))))
    ends = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda s: s["end"].cast("int")))
    apart = lambda s, last: F.when(s.isNull(), last <= F.length(utterance)).otherwise((s["start"] >= last) & (s["end"] > s["start"]))
    o = lambda n: F.array_repeat(F.lit("O"), n)
    inside = lambda s: F.concat(F.array(F.concat(F.lit("B-"), s["type"])), F.array_repeat(F.concat(F.lit("I-"), s["type"]), (s["end"] - s["start"] - 1).cast("int")))
    runs = F.zip_with(ordered, ends, lambda s, last: F.when(s.isNull(), o(F.length(utterance) - last)).otherwise(F.concat(o((s["start"] - last).cast("int")), inside(s))))
    fine = F.coalesce(F.forall(F.zip_with(ordered, ends, apart), lambda x: x), F.lit(False))
    each = F.transform(F.sequence(F.lit(0), F.length(utterance) - 1), tag)
    return F.when(F.length(utterance) == 0, F.expr("cast(array() as array<string>)")).when(fine, F.flatten(runs)).otherwise(each)


#: Stands for what lies beyond the ends of a text.
BOUNDARY = "<BOUNDARY>"
WINDOWS = "a string, b string, c string, d string, e string, n long"
_EDGE = 0x110000  # past the last code point, in 21 bits
_TOGETHER = 2_000_000


def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: texts (the only column) to ``WINDOWS``, each character with two on either side and how often these stand so.

    Equal windows of up to two million characters are counted together by sorting their code points, 63 and 42 bits a window."""
    gap = np.full(2, _EDGE, dtype="<u4").tobytes()

    def counted(texts: list[str]) -> pa.RecordBatch:
        code = np.frombuffer(gap + gap.join(t.encode("utf-32-le") for t in texts) + gap, dtype="<u4").astype(np.int64)
        at = np.flatnonzero(code != _EDGE)
        left, right = code[at - 2] << 21 | code[at - 1], code[at] << 42 | code[at + 1] << 21 | code[at + 2]
        order = np.lexsort((left, right))
        left, right = left[order], right[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        mask = (1 << 21) - 1
        columns = []
        for c in (left[new] >> 21, left[new] & mask, right[new] >> 42, right[new] >> 21 & mask, right[new] & mask):
            known, place = np.unique(c, return_inverse=True)
            columns.append(pa.array([BOUNDARY if k == _EDGE else chr(k) for k in known.tolist()], pa.string()).take(pa.array(place)))
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(np.append(new, len(left))))], [*"abcde", "n"])

    held, size = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                held.append(t)
                size += len(t)
            if size >= _TOGETHER:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def span_errors(utterance: Column, spans: Column) -> Column:
    """Whether a span is empty, out of bounds or overlaps another."""
    wrong = F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] > F.length(utterance)) | (s["start"] >= s["end"]))
    return wrong | F.exists(spans, lambda a: F.size(F.filter(spans, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))) > 1)


def slots_from_bio(df: DataFrame, key: str, utterance: str, tags: str) -> DataFrame:
    """(key, slots): slots of a tag sequence. An I- tag that goes on with nothing begins a slot.

    A slot lies within its row, so nothing is shuffled: it begins and ends at the places whose tag isn't O and doesn't go on.
    """
    none = F.expr("cast(array() as array<struct<type:string,value:string>>)")
    tag = lambda i: F.get("_tags", i)
    kind = lambda t: F.substring(t, 3, 1 << 30)
    goes_on = lambda i: F.coalesce((i > 0) & tag(i).startswith("I-") & (tag(i - 1) != "O") & (kind(tag(i - 1)) == kind(tag(i))), F.lit(False))
    places = F.filter(F.transform("_tags", lambda t, i: F.when(t != "O", i)), lambda i: i.isNotNull())
    rows = once(df.select(key, F.col(utterance).alias("_text"), F.col(tags).alias("_given")), _tags=F.col("_given"))
    rows = once(rows.select(key, "_text", "_tags"), _places=places)
    rows = once(rows, _ends=F.zip_with(F.filter("_places", lambda i: ~goes_on(i)), F.filter("_places", lambda i: ~goes_on(i + 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    slots = F.transform("_ends", lambda r: F.struct(kind(tag(r["a"])).alias("type"), F.substring(F.col("_text"), r["a"] + 1, r["b"] - r["a"] + 1).alias("value")))
    return rows.select(key, F.coalesce(slots, none).alias("slots"))
