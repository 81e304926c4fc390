"""Models: choice between systems, TF-IDF, linear classifiers, Viterbi decoding."""

import json
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, FeatureHasher, StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import bio_tags
from millrace.tables import BROADCAST_ROWS, written

from .checks import ConstraintError

#: Fixed value.
MEAN_LOGPROB_THRESHOLD = -0.08


def choose_hybrid(df: DataFrame, old: str, new: str, parsed: str, logprob: str, threshold: float = MEAN_LOGPROB_THRESHOLD) -> DataFrame:
    """Takes the new output where it is valid, has slots and is likely enough; else the old one."""
    p, lp = F.col(parsed), F.col(logprob)
    sure = lp.isNotNull() & ~F.isnan(lp) & (F.abs(lp) < float("inf")) & (lp >= threshold)
    take = F.coalesce(p["json_valid"] & p["schema_valid"] & p["copy_valid"] & (F.size(p["slots"]) > 0) & sure, F.lit(False))
    return df.withColumn("replaced", take).withColumn("chosen", F.when(F.col("replaced"), F.col(new)).otherwise(F.col(old)))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of low to high characters, in order of length.

    Each length is made from the one before by pairing arrays, so the work is linear in the text."""
    chars = F.split(text, "")
    grams, out = chars, []
    for n in range(1, high + 1):
        if n > 1:
            grams = F.zip_with(grams, F.slice(chars, n, F.greatest(F.size(chars), F.lit(1))), lambda g, c: F.concat(g, c))
        if n >= low:
            out.append(F.filter(grams, lambda g: g.isNotNull() & (g != "")))
    return F.concat(*out)


#: Rows of term counts that leave Python together, about.
_COUNTED = 100_000


def term_counts(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, term, tf): how often each character n-gram of low to high characters occurs in the texts of a key.

    The texts of a key are counted where they meet, a key at a time: a table of all terms of all keys of a task, which an aggregation
    of exploded n-grams holds, would grow with the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, terms, n = [], [], []
            for i, texts in enumerate(batch.column(1)):  # a key's texts become Python's one at a time
                own = Counter()
                for t in texts.as_py():
                    for k in range(low, high + 1):
                        own.update([t[j : j + k] for j in range(len(t) - k + 1)])
                row.append(np.full(len(own), i))
                terms.extend(own)
                n.extend(own.values())
                if len(terms) >= _COUNTED or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(terms, pa.string()), pa.array(n, pa.int64())], [key, "term", "tf"])
                    row, terms, n = [], [], []

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return df.groupBy(key).agg(F.collect_list(text).alias("_texts")).mapInArrow(count, schema)


def tfidf(df: DataFrame, key: str, text: str, low: int, high: int, min_df: int = 2) -> DataFrame:
    """(key, term, weight): sublinear term frequency times ln((1 + n) / (1 + df)) + 1, rows of length 1.

    Counts are made once and written. Terms are broadcast only if they are few by number; else they meet by a shuffle, and the
    driver, where Spark would put together whatever looks small when compressed, holds none of them.
    """
    counts = written(term_counts(df, key, text, low, high))
    n = df.select(F.count_distinct(key)).first()[0]
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    idf = written(seen.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    idf = F.broadcast(idf) if idf.count() <= BROADCAST_ROWS else idf.hint("merge")
    raw = counts.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


class TermWeights(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Counts to TF-IDF: (1 + ln tf) times a term's weight, rows of length 1."""

    weights = Param(Params._dummy(), "weights", "ln((1 + n) / (1 + df)) + 1 of each term", TypeConverters.toListFloat)
    inputCol = Param(Params._dummy(), "inputCol", "counts", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "weighted", TypeConverters.toString)

    def __init__(self, inputCol: str = "_n", outputCol: str = "_x", weights: list[float] | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, weights=weights or [])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        idf = np.array(self.getOrDefault(self.weights))

        def weigh(v):
            w = (1 + np.log(v.values)) * idf[v.indices]
            return SparseVector(v.size, v.indices, w / (np.linalg.norm(w) or 1.0))

        return dataset.withColumn(self.getOrDefault(self.outputCol), F.udf(weigh, VectorUDT())(self.getOrDefault(self.inputCol)))


def fit_linear(train: DataFrame, grams: str, label: str, vocabulary: int = 1 << 16, min_df: int = 2) -> PipelineModel:
    """TF-IDF of n-grams into one linear machine per class. The hinge here is plain, not squared.
    The vectors are made once and kept for the iterations."""
    counted = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep"), CountVectorizer(inputCol=grams, outputCol="_n", vocabSize=vocabulary, minDF=min_df)]).fit(train)
    rows = counted.transform(train)
    idf = IDF(inputCol="_n", outputCol="_i").fit(rows)
    weigh = TermWeights(weights=[float(x) for x in np.log((1 + idf.numDocs) / (1 + np.array(idf.docFreq))) + 1])
    ready = weigh.transform(rows).select("_x", "_y").persist()
    try:
        machines = OneVsRest(classifier=LinearSVC(featuresCol="_x", labelCol="_y", maxIter=10), featuresCol="_x", labelCol="_y").fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel([*counted.stages, weigh, machines])


def bio_features(df: DataFrame, utterance: str, *keep: str) -> DataFrame:
    """A row for each character: pos, and what stands there, before and after it, and what kinds these are."""
    chars = F.split(utterance, "")
    rows = df.select(*keep, F.size(chars).alias("_n"), chars.alias("_c"), F.posexplode(chars).alias("pos", "char"))
    at = lambda k: F.when((F.col("pos") + k < 0), F.lit("<s>")).when(F.col("pos") + k >= F.col("_n"), F.lit("</s>")).otherwise(F.get("_c", F.col("pos") + k))
    kind = F.when(F.col("char").rlike(r"\p{N}"), "digit").when(F.col("char").rlike(r"\p{IsAlphabetic}"), "letter").when(F.col("char").rlike(r"\s"), "space").otherwise("other")
    return rows.select(*keep, "pos", "char", *[at(k).alias(n) for k, n in ((-2, "b2"), (-1, "b1"), (1, "a1"), (2, "a2"))], kind.alias("kind")).withColumns({"left": F.concat("b1", "char"), "right": F.concat("char", "a1")})


def fit_bio(train: DataFrame, utterance: str, spans: str, key: str = "id", size: int = 1 << 12) -> PipelineModel:
    """The tagger: features of each character, tags of the spans, balanced weights, one linear machine per tag."""
    features = bio_features(train, utterance, key, spans).join(train.select(key, F.posexplode(bio_tags(F.col(utterance), F.col(spans))).alias("pos", "tag")), [key, "pos"])
    rows = balanced_weight(features, "tag").persist()
    try:
        return bio_classifier(["char", "b1", "b2", "a1", "a2", "kind", "left", "right"], "tag", size).fit(rows)
    finally:
        rows.unpersist()


def save_model(model: PipelineModel, path: str, facts: Mapping[str, object]) -> None:
    """A model with the facts (training file, settings) that a reader has to know it by. The path must not exist."""
    model.save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(dict(facts), sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/facts")


def load_model(path: str, expected: Mapping[str, object]) -> PipelineModel:
    """The model, if its facts are the expected ones; nothing of it is loaded before that."""
    rows = SparkSession.getActiveSession().read.text(f"{path}/facts").collect()
    if len(rows) != 1 or json.loads(rows[0]["value"]) != dict(expected):
        raise ConstraintError(f"the model at {path} isn't the one expected")
    return PipelineModel.load(path)


def bio_classifier(features: list[str], label: str, size: int = 1 << 12) -> Pipeline:
    """Hashed contextual features of a character into one linear machine per tag; column _weight balances the tags."""
    return Pipeline(stages=[FeatureHasher(inputCols=features, outputCol="_x", numFeatures=size), StringIndexer(inputCol=label, outputCol="_y"), OneVsRest(classifier=LinearSVC(featuresCol="_x", labelCol="_y", weightCol="_weight", maxIter=5), featuresCol="_x", labelCol="_y", weightCol="_weight")])


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Adds _weight = n / (classes * n of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    one = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weight = n.crossJoin(F.broadcast(one)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_weight"))  # one row
    return df.join(weight, label)  # a row for each label: broadcast by its size, if that is small


def viterbi(scores: np.ndarray, classes: list[str]) -> list[str]:
    """The best tag sequence in which I- follows B- or I- of its type. The first of equal ones wins.

    All transitions of a step are one matrix operation."""
    if not len(scores):
        return []
    kind = np.array([c[2:] for c in classes])
    inside = np.array([c.startswith("I-") for c in classes])
    may = np.where(inside[None, :], (kind[:, None] == kind[None, :]) & np.array([c != "O" for c in classes])[:, None], True)
    bonus = np.where(may, 0.0, -np.inf)
    state, back = np.where(inside, -np.inf, scores[0]), []
    for row in scores[1:]:
        ways = state[:, None] + bonus
        back.append(ways.argmax(0))
        state = ways.max(0) + row
    best = int(state.argmax())
    if not np.isfinite(state[best]):
        raise ValueError("no legal tag sequence")
    path = [best]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return [classes[i] for i in reversed(path)]


def viterbi_decode(scores: Column, classes: list[str]) -> Column:
    """Tags for a column array<array<double>>: a row of scores, one for each class, per character."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([viterbi(np.array([np.asarray(x) for x in r], dtype=float).reshape(len(r), len(classes)), classes) for r in rows], dtype=object)

    return decode(scores)



