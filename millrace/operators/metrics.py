"""Scores of predictions: classification, entities, error taxonomy, overlap."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spans import TARGET_TYPES
from millrace.tables import once

INVALID = "<INVALID>"


def ratio(a, b) -> Column:
    """a / b, and 0.0 for b = 0."""
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b), F.lit(0.0)).cast("double")


def normalise(df: DataFrame, labels: list[str], given: str, raw: str, to: str = "prediction") -> DataFrame:
    """The prediction given, or else the stripped output; null if it isn't a label."""
    text = F.coalesce(F.col(given), F.regexp_replace(F.col(raw), r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$", ""))
    return df.withColumn(to, F.when(text.isin(labels), text))


# --- classification ----------------------------------------------------------------------


def confusion(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Counts by gold class and prediction: all that the scores need, at most classes squared rows."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred"), *by).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """Support, hits, predictions, precision, recall and F1 of each gold class."""
    support = counts.groupBy("gold").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = counts.where("pred is not null").groupBy(F.col("pred").alias("gold")).agg(F.sum("n").alias("predicted"))
    both = support.join(predicted, "gold", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0).cast("long")))
    return both.select("gold", "support", "tp", "predicted", ratio("tp", "predicted").alias("precision"), ratio("tp", "support").alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def classification_score(counts: DataFrame) -> DataFrame:
    """One row: rows, correct, valid, unknown, invalid, accuracy, macro-F1 over the gold classes."""
    classes = counts.select("gold").distinct().withColumn("known", F.lit(True))
    marked = counts.join(classes.withColumnRenamed("gold", "pred"), "pred", "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    one = marked.agg(
        F.sum("n").alias("n"), n(F.col("gold") == F.col("pred")).alias("n_correct"), n(F.col("known").isNotNull()).alias("n_valid"),
        n(F.col("known").isNull() & F.col("pred").isNotNull()).alias("n_unknown"), n(F.col("pred").isNull()).alias("n_invalid"),
    )
    macro = per_class(counts).agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))
    return one.crossJoin(macro).withColumn("accuracy", ratio("n_correct", "n"))  # one row each


def errors_of(counts: DataFrame) -> DataFrame:
    """Confusions: gold class, prediction (or <INVALID>) and count, right ones left out."""
    return counts.where(~F.col("gold").eqNullSafe(F.col("pred"))).select("gold", F.coalesce("pred", F.lit(INVALID)).alias("pred"), "n")


# --- entities ----------------------------------------------------------------------------


def slot_counts(slots: Column) -> Column:
    """Distinct slots with how often each occurs: array<struct<type, value, n>>."""
    return F.transform(F.array_distinct(slots), lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"), F.size(F.filter(slots, lambda x: x == s)).alias("n")))


def same_multiset(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_sort(a) == F.array_sort(b), F.lit(False))


def entity_counts(df: DataFrame, gold: str, pred: str, *keep: str) -> DataFrame:
    """Adds tp, fp, fn of each row, by type too (map type -> struct): multisets within the row, no join.

    A null prediction counts as none. Rows without slots stay.
    """
    g, p = F.col("_g"), F.col("_p")
    df = df.select(*keep, F.col(gold).alias("_g"), F.coalesce(F.col(pred), F.expr("cast(array() as array<struct<type:string,value:string>>)")).alias("_p"), F.col(pred).isNotNull().alias("valid"))
    every = slot_counts(F.concat(g, p))
    # counts on either side of each distinct slot
    sides = F.transform(every, lambda s: F.struct(s["type"].alias("type"), F.size(F.filter(g, lambda x: (x["type"] == s["type"]) & (x["value"] == s["value"]))).alias("g"), F.size(F.filter(p, lambda x: (x["type"] == s["type"]) & (x["value"] == s["value"]))).alias("p")))
    df = once(df.select(*keep, "valid", "_g", "_p"), _s=sides)
    add = lambda f: F.aggregate("_s", F.lit(0).cast("long"), lambda acc, s: acc + f(s))
    return df.select(
        *keep, "valid", F.size("_g").cast("long").alias("n_gold"), F.size("_p").cast("long").alias("n_pred"), "_s",
        add(lambda s: F.least(s["g"], s["p"])).alias("tp"), add(lambda s: F.greatest(s["p"] - s["g"], F.lit(0))).alias("fp"), add(lambda s: F.greatest(s["g"] - s["p"], F.lit(0))).alias("fn"),
    ).withColumn("exact", F.col("valid") & (F.col("fp") == 0) & (F.col("fn") == 0))


def f1_of(tp, fp, fn) -> Column:
    """Null for no entity on either side."""
    return F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)


_SUMS = ("n", "n_exact", "n_invalid", "tp", "fp", "fn", "n_no_slot", "n_no_slot_fp", "n_no_slot_invalid")


def entity_cells(rows: DataFrame, *by: Column, **more: Column) -> DataFrame:
    """The sums that scores need over the rows of ``entity_counts``, by the columns given; ``more`` are counted where they hold.

    Scores of all rows and of some of them come from one table of cells, and so from one reading of the outputs."""
    none = F.col("n_gold") == 0
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("valid")).alias("n_invalid"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.count_if(none).alias("n_no_slot"), F.count_if(none & F.col("valid") & (F.col("n_pred") > 0)).alias("n_no_slot_fp"), F.count_if(none & ~F.col("valid")).alias("n_no_slot_invalid"),
        *[F.count_if(c).alias(name) for name, c in more.items()],
    )


def prf_of_cells(cells: DataFrame, *more: str) -> DataFrame:
    """One row: the sums over all cells, and the scores."""
    t = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*_SUMS, *more)])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1_of(tp, fp, fn).alias("micro_f1"), ratio("n_exact", "n").alias("exact_rate"))


def entity_prf(rows: DataFrame) -> DataFrame:
    """One row over the rows of ``entity_counts``."""
    return prf_of_cells(entity_cells(rows))


def entity_prf_by_type(rows: DataFrame, types=TARGET_TYPES) -> DataFrame:
    """A row for each type, those without entities included."""
    s = rows.select(F.explode("_s").alias("s")).select("s.*")
    t = s.groupBy("type").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    every = rows.sparkSession.createDataFrame([(x,) for x in types], "type string")
    out = every.join(t, "type", "left").select("type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1_of(tp, fp, fn).alias("f1"))


#: The categories of the error taxonomy.
CATEGORIES = (
    "fully_correct", "incorrect", "invalid_json", "invalid_schema", "invalid_copy", "missed_all_gold_slots", "missed_all_gold_slots_valid_output", "extra_slots_on_gold_empty", "partial_correct",
    "type_confusion_same_value", "same_type_different_value", "possible_span_boundary_mismatch", "duplicate_slot_output", "excess_duplicate_slot",
)


def _rest(a: Column, b: Column) -> Column:
    """Slots of a that b doesn't match, as distinct slots whose count in a is higher."""
    count = lambda where, s: F.size(F.filter(where, lambda x: (x["type"] == s["type"]) & (x["value"] == s["value"])))
    return F.filter(F.array_distinct(a), lambda s: count(a, s) > count(b, s))


def taxonomy_flags(df: DataFrame, gold: str, pred: str, parsed: str, *keep: str) -> DataFrame:
    """The overlapping error flags of each row; pairs are compared within the row's own slots."""
    g = F.col(gold)
    valid, p = F.col(pred).isNotNull(), F.coalesce(F.col(pred), F.expr("cast(array() as array<struct<type:string,value:string>>)"))
    df = df.select("*", g.alias("_g"), p.alias("_p"), valid.alias("_v"), _rest(g, p).alias("_gr"), _rest(p, g).alias("_pr"))
    g, p, v = F.col("_g"), F.col("_p"), F.col("_v")
    pair = lambda f: v & F.exists("_gr", lambda a: F.exists("_pr", lambda b: f(a, b)))
    exact = v & same_multiset(g, p)
    tp = F.size(g) - F.aggregate(F.array_distinct(g), F.lit(0), lambda acc, s: acc + F.greatest(F.size(F.filter(g, lambda x: x == s)) - F.size(F.filter(p, lambda x: x == s)), F.lit(0)))
    j, s, c = (F.col(parsed)[x] for x in ("json_valid", "schema_valid", "copy_valid"))
    within = lambda a, b: a["value"].contains(b["value"]) | b["value"].contains(a["value"])
    flags = {
        "fully_correct": exact,
        "incorrect": ~exact,
        "invalid_json": ~j,
        "invalid_schema": j & ~s,
        "invalid_copy": s & ~c,
        "missed_all_gold_slots": (F.size(g) > 0) & (tp == 0),
        "missed_all_gold_slots_valid_output": v & (F.size(g) > 0) & (tp == 0),
        "extra_slots_on_gold_empty": v & (F.size(g) == 0) & (F.size(p) > 0),
        "partial_correct": v & (tp > 0) & ~exact,
        "type_confusion_same_value": pair(lambda a, b: (a["value"] == b["value"]) & (a["type"] != b["type"])),
        "same_type_different_value": pair(lambda a, b: (a["type"] == b["type"]) & (a["value"] != b["value"])),
        "possible_span_boundary_mismatch": pair(lambda a, b: (a["type"] == b["type"]) & (a["value"] != b["value"]) & within(a, b)),
        "duplicate_slot_output": v & (F.size(F.array_distinct(p)) < F.size(p)),
        "excess_duplicate_slot": v & F.exists(F.array_distinct(p), lambda s: F.size(F.filter(p, lambda x: x == s)) > F.greatest(F.lit(1), F.size(F.filter(g, lambda x: x == s)))),
    }
    return df.select(*keep, *[flags[x].alias(x) for x in CATEGORIES], (F.size(g) > 0).alias("_has"), (F.size(g) == 0).alias("_none"))


def taxonomy(flags: DataFrame) -> DataFrame:
    """(category, n, denominator, rate): missed-all is a rate of rows with slots, extra-on-empty of rows without; the rate is
    null for an empty denominator."""
    one = flags.agg(*[F.count_if(c).alias(c) for c in CATEGORIES], F.count(F.lit(1)).alias("_n"), F.count_if("_has").alias("_has"), F.count_if("_none").alias("_none"))
    base = {"missed_all_gold_slots": "_has", "missed_all_gold_slots_valid_output": "_has", "extra_slots_on_gold_empty": "_none"}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), F.col(base.get(c, "_n")).alias("denominator")) for c in CATEGORIES]))
    return one.select(rows.alias("r")).select("r.*").withColumn("rate", F.try_divide("n", "denominator"))


# --- overlap -----------------------------------------------------------------------------


def overlap_flags(df: DataFrame, key: str, priors: dict[str, DataFrame]) -> DataFrame:
    """A boolean column for each prior set of keys. Keys meet by their hash."""
    digest = F.unhex(F.sha2(key, 256)).alias("_h")
    df = df.select("*", digest)
    for name, prior in priors.items():
        df = df.join(prior.select(digest).distinct().withColumn(name, F.lit(True)), "_h", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df.drop("_h")
