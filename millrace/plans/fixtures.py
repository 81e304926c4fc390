"""Inputs derived from the driver's tables, each as a DataFrame and as a SQL table expression.

An utterance is a line of a document; ids are '<doc_id>-<line>'. Annotations, predictions and
model outputs are made from md5 hashes of ids, so both engines make the same ones.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.hashing import bucket_hash
from millrace.functions.spans import TARGET_TYPES
from millrace.tables import once

TYPES_SQL = "['" + "','".join(TARGET_TYPES) + "']"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def H(salt: str, key: str) -> str:
    """``bucket_hash`` in SQL."""
    return f"('0x' || substr(md5('{salt}|' || {key}), 1, 8))::BIGINT"


def partition_of(key: str):
    b = bucket_hash("part", key) % 10
    return F.when(b == 0, "test").when(b == 1, "dev").otherwise("train")


def documents(spark, sf_dir) -> DataFrame:
    """Documents with their keys and a partition."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", partition_of("doc_id").alias("part"), keys.key_weak(t).alias("weak"), keys.key_strong(t).alias("strong"), keys.key_alnum(t).alias("alnum")
    )


FOLD = "replace(lower(text), 'ß', 'ss')"
DOCS = f"""docs AS (SELECT doc_id, text, lang, source,
  CASE {H("part", "doc_id")} % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS part,
  regexp_replace({FOLD}, '[\\s\\p{{Z}}]', '', 'g') AS weak,
  regexp_replace({FOLD}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g') AS strong,
  regexp_replace({FOLD}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS alnum FROM documents)"""

LABELS = ("de", "en", "es", "fr")


def class_predictions(docs: DataFrame, salt: str = "pred") -> DataFrame:
    """(id, gold, scenario, raw_output, prediction): mostly right, else another class, null or unknown."""
    c = bucket_hash(salt, "doc_id") % 10
    labels = F.array(*map(F.lit, LABELS))
    other = F.element_at(labels, (F.array_position(labels, F.col("lang")) % len(LABELS) + 1).cast("int"))
    raw = F.when(c <= 6, F.concat(F.lit(" "), "lang", F.lit("\n"))).when(c == 7, other).when(c == 8, F.lit("")).otherwise(F.lit("??"))
    return docs.select("doc_id", "part", "source", F.col("lang").alias("gold"), raw.alias("raw_output"), F.when(c == 6, F.lit("en")).alias("given"))


def predictions_sql(name: str = "preds", salt: str = "pred") -> str:
    labels = "['" + "','".join(LABELS) + "']"
    return f"""{name} AS (SELECT doc_id, part, source, lang AS gold,
  CASE WHEN c <= 6 THEN ' ' || lang || chr(10) WHEN c = 7 THEN {labels}[list_position({labels}, lang) % 4 + 1] WHEN c = 8 THEN '' ELSE '??' END AS raw_output,
  CASE WHEN c = 6 THEN 'en' END AS given FROM (SELECT *, {H(salt, "doc_id")} % 10 AS c FROM docs))"""


def utterances(spark, sf_dir) -> DataFrame:
    """(id, doc_id, scenario, part, utt, annot_utt, slots, any_type): every line that isn't blank, annotated.

    A word, or two, is marked; a fifth of the lines has no mark and a tenth one of a type that isn't a target.
    """
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "utt")).where("trim(utt) <> ''")
    u = lines.select(F.concat_ws("-", "doc_id", "pos").alias("id"), "doc_id", F.col("source").alias("scenario"), partition_of("doc_id").alias("part"), "utt", F.split("utt", " ").alias("w"))
    n = F.size("w").cast("bigint")
    types = F.array(*map(F.lit, TARGET_TYPES))
    t = bucket_hash("type", "id") % 10
    u = u.select("*", (bucket_hash("word", "id") % n).cast("int").alias("a"), (bucket_hash("second", "id") % n).cast("int").alias("b"), t.alias("t"), (bucket_hash("two", "id") % 3 == 0).alias("two"))
    word = lambda i: F.get("w", F.col(i))
    open_ = (F.col("t") >= 2) & (word("a") != "") & ~F.col("utt").rlike(r"[\[\]]")
    u = u.select(
        "*",
        open_.alias("marked"),
        (open_ & F.col("two") & (F.col("a") != F.col("b")) & (word("b") != "")).alias("both"),
        F.when(F.col("t") == 2, F.lit("song_name")).otherwise(F.element_at(types, (F.col("t") % 4 + 1).cast("int"))).alias("ta"),
        F.element_at(types, (bucket_hash("type2", "id") % 4 + 1).cast("int")).alias("tb"),
    )
    # words are replaced by their places: within a transform, Spark would look for brackets in the whole line at each word
    mark = lambda w, kind, i: F.concat(F.slice(w, F.lit(1), F.col(i)), F.array(F.concat(F.lit("["), F.col(kind), F.lit(" : "), word(i), F.lit("]"))), F.slice(w, F.col(i) + 2, F.size("w")))
    one = mark(F.col("w"), "ta", "a")
    annot = F.when(F.col("both"), F.array_join(mark(one, "tb", "b"), " ")).when(F.col("marked"), F.array_join(one, " ")).otherwise(F.col("utt"))
    slot = lambda kind, i: F.struct(F.col(kind).alias("type"), word(i).alias("value"))
    none = F.expr("cast(array() as array<struct<type:string,value:string>>)")
    first, second = F.when(F.col("marked") & (F.col("t") != 2), F.array(slot("ta", "a"))).otherwise(none), F.when(F.col("both"), F.array(slot("tb", "b"))).otherwise(none)
    slots = F.when(F.col("a") < F.col("b"), F.concat(first, second)).otherwise(F.concat(second, first))
    return u.select("id", "doc_id", "scenario", "part", "utt", annot.alias("annot_utt"), slots.alias("slots"), F.col("marked").alias("any_type"))


UTTS = f"""utt_words AS (SELECT doc_id || '-' || pos AS id, doc_id, source AS scenario, CASE {H("part", "doc_id")} % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS part,
    utt, string_split(utt, ' ') AS w FROM (SELECT doc_id, source, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS utt FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(utt) <> ''),
utt_places AS (SELECT *, {H("word", "id")} % len(w) + 1 AS a, {H("second", "id")} % len(w) + 1 AS b, {H("type", "id")} % 10 AS t, {H("two", "id")} % 3 = 0 AS two FROM utt_words),
utt_marks AS (SELECT *, t >= 2 AND w[a] <> '' AND NOT regexp_matches(utt, '[\\[\\]]') AS marked, marked AND two AND a <> b AND w[b] <> '' AS both_,
    CASE WHEN t = 2 THEN 'song_name' ELSE {TYPES_SQL}[t % 4 + 1] END AS ta, {TYPES_SQL}[{H("type2", "id")} % 4 + 1] AS tb FROM utt_places),
utts AS (SELECT id, doc_id, scenario, part, utt,
    array_to_string(list_transform(w, lambda x, i: CASE WHEN marked AND i = a THEN '[' || ta || ' : ' || x || ']' WHEN both_ AND i = b THEN '[' || tb || ' : ' || x || ']' ELSE x END), ' ') AS annot_utt,
    list_transform(list_filter(list_sort([CASE WHEN marked AND t <> 2 THEN {{'i': a, 'type': ta, 'value': w[a]}} END, CASE WHEN both_ THEN {{'i': b, 'type': tb, 'value': w[b]}} END]), lambda s: s IS NOT NULL), lambda s: {{'type': s.type, 'value': s.value}}) AS slots,
    marked AS any_type FROM utt_marks)"""


def raw_outputs(utts: DataFrame, salt: str | Column = "raw") -> DataFrame:
    """Adds raw_output: the canonical JSON of the slots, untouched in 6 of 16 cases and spoilt in the others."""
    c = bucket_hash(salt, "id") % 16
    types = F.array(*map(F.lit, TARGET_TYPES))
    s = F.col("slots")
    js = lambda slots: F.to_json(F.struct(slots.alias("slots")))
    change = lambda kind=None, value=None: F.transform(s, lambda x: F.struct((kind(x) if kind else x["type"]).alias("type"), (value(x) if value else x["value"]).alias("value")))
    cases = {
        6: js(F.slice(s, 2, 9)),
        7: js(F.concat(s, s)),
        8: js(change(kind=lambda x: F.element_at(types, (F.array_position(types, x["type"]) % 4 + 1).cast("int")))),
        9: js(change(value=lambda x: F.substring(x["value"], F.lit(1), F.greatest(F.length(x["value"]) - 1, F.lit(1))))),
        10: js(change(value=lambda x: F.substring(F.col("utt"), F.instr(F.col("utt"), x["value"]), F.length(x["value"]) + 2))),
        11: js(change(value=lambda x: F.concat(x["value"], F.lit("☃")))),
        12: F.substring(js(s), F.lit(1), F.length(js(s)) - 1),
        13: F.concat(F.lit('{"slots":[],'), F.substring(js(s), F.lit(2), F.length(js(s)))),
        14: F.concat(F.substring(js(s), F.lit(1), F.length(js(s)) - 1), F.lit(',"x":1}')),
        15: F.lit('{"slots":[{"type":"date","value":1}]}'),
    }
    raw = reduce(lambda acc, case: acc.when(c == case[0], case[1]), list(cases.items())[1:], F.when(c == 6, cases[6])).otherwise(js(s))
    return once(utts, slots=s, raw_output=raw).select(*utts.columns, "raw_output")


def _case(value: str, kind: str = "s.type") -> str:
    return f"to_json({{'slots': list_transform(slots, lambda s: {{'type': {kind}, 'value': {value}}})}})::VARCHAR"


def raw_sql(name: str = "raws", salt: str = "raw", utts: str = "utts") -> str:
    js = "to_json({'slots': slots})::VARCHAR"
    return f"""{name} AS (SELECT *, CASE c WHEN 6 THEN to_json({{'slots': slots[2:]}})::VARCHAR WHEN 7 THEN to_json({{'slots': slots || slots}})::VARCHAR
  WHEN 8 THEN {_case("s.value", f"{TYPES_SQL}[list_position({TYPES_SQL}, s.type) % 4 + 1]")}
  WHEN 9 THEN {_case("substr(s.value, 1, greatest(length(s.value) - 1, 1))")}
  WHEN 10 THEN {_case("substr(utt, instr(utt, s.value), length(s.value) + 2)")}
  WHEN 11 THEN {_case("s.value || '☃'")}
  WHEN 12 THEN substr(js, 1, length(js) - 1) WHEN 13 THEN '{{"slots":[],' || substr(js, 2) WHEN 14 THEN substr(js, 1, length(js) - 1) || ',"x":1}}'
  WHEN 15 THEN '{{"slots":[{{"type":"date","value":1}}]}}' ELSE js END AS raw_output FROM (SELECT *, {js} AS js, {H(salt, "id")} % 16 AS c FROM {utts}))"""


def parsed_sql(name: str = "parsed", raws: str = "raws") -> str:
    """The strict parser in SQL, for outputs spoilt as above: error, and pred (null if invalid)."""
    n_slots = "json_array_length(raw_output, '$.slots')::BIGINT"
    return f"""{name}_e AS (SELECT *, CASE WHEN NOT json_valid(raw_output) THEN 'invalid_json'
    WHEN length(raw_output) - length(replace(raw_output, '"slots":', '')) > 8 THEN 'duplicate_json_key'
    WHEN json_keys(raw_output) <> ['slots'] OR json_type(raw_output, '$.slots') <> 'ARRAY' THEN 'invalid_top_level_schema'
    WHEN len(list_filter(range({n_slots}), lambda i: json_keys(json_extract(raw_output, '$.slots[' || i || ']')) <> ['type', 'value'])) > 0 THEN 'invalid_slot_schema'
    WHEN len(list_filter(range({n_slots}), lambda i: json_type(raw_output, '$.slots[' || i || '].value') <> 'VARCHAR' OR NOT list_contains({TYPES_SQL}, json_extract_string(raw_output, '$.slots[' || i || '].type')) OR trim(json_extract_string(raw_output, '$.slots[' || i || '].value')) = '')) > 0 THEN 'invalid_slot_type_or_value'
    WHEN len(list_filter(range({n_slots}), lambda i: NOT contains(utt, json_extract_string(raw_output, '$.slots[' || i || '].value')))) > 0 THEN 'value_not_copied_from_utterance' END AS error FROM {raws}),
{name} AS (SELECT *, error IS NULL OR error <> 'invalid_json' AS json_valid, error IS NULL OR error = 'value_not_copied_from_utterance' AS schema_valid, error IS NULL AS copy_valid,
    CASE WHEN error IS NULL THEN list_transform(range({n_slots}), lambda i: {{'type': json_extract_string(raw_output, '$.slots[' || i || '].type'), 'value': json_extract_string(raw_output, '$.slots[' || i || '].value')}}) END AS pred FROM {name}_e)"""
