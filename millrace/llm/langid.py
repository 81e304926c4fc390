"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters, lower-cased, with a blank between words, are cut into all their byte n-grams of
1 to 4; each is hashed to one of ``BUCKETS`` rows of an embedding table, the rows are averaged
over the whole text, and a linear layer with softmax gives a probability per language. Table
and layer are trained together by stochastic gradient descent in numpy.

The fit uses a bounded, documented sample: of each language the distinct texts with the smallest
hashes, ``sample`` over the number of languages (or all it has, if fewer), each counted as a whole. No language
goes without: where there are so many that fewer than ``LEAST_TEXTS`` would be left for each, each gets that many.
Texts are turned into n-gram counts where they are stored, so what reaches the driver is bounded by
BUCKETS numbers a text of the sample.

Calibration and rejection: a fifth of the sample is kept from training. On it a temperature is
fitted, so that the score is a probability. A document is rejected if it has no letter, if
its share of pairs of bytes that occur in the sample is below what all but one in a thousand of the kept
texts reach (0.9 at most: another script or an encoding gone wrong), or if its score is below
what they reach (at most 1.05 times that of a blind guess).

Defined cases: null text and text without a letter (digits, emoji, marks alone) give ``und`` with score 0 and are rejected;
null languages are not learned; with no labelled text, or an empty table to learn from, every document is ``und``; ties go to
the first language in order; repeated rows are predicted alike and one text counts once in the sample; very long texts count
as a whole, piece by piece; an empty table gives no rows; extra columns are kept by ``identify``, but for those named
lang_pred, score and rejected. The sample is drawn by hash, so the same documents in any order or partitioning give the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table

BUCKETS = 1 << 12
DIMS = 16
ORDERS = (1, 2, 3, 4)
#: Labelled texts that the fit takes at most, unless LEAST_TEXTS of each language are more.
SAMPLE = 2000
LEAST_TEXTS = 5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Marks belong to the letters before them, but don't make a word by themselves.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_PIECE = 1 << 18


def letters(text: str | None) -> np.ndarray | None:
    """The bytes of the whole text's words, or None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    return np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8)


def byte_pairs(data: np.ndarray) -> np.ndarray:
    return data[:-1].astype(np.uint16) << 8 | data[1:]


def ngram_counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs."""
    out = np.zeros(BUCKETS, np.float32)
    longest = ORDERS[-1]
    for at in range(0, len(data), _PIECE):  # long texts in pieces, each n-gram in one of them
        part = data[at : at + _PIECE + longest - 1].astype(np.uint32)
        rolling = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            rolling = rolling[:size] * np.uint32(0x01000193) + part[n - 1 : n - 1 + size] + np.uint32(1)
            mixed = rolling[: min(size, _PIECE)] * np.uint32(0x9E3779B1)
            out += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the layer, which is all that a prediction needs
    bias: np.ndarray
    known: np.ndarray
    temperature: float
    least_score: float
    least_known: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        data = letters(text)
        if data is None or not self.languages:
            return UNKNOWN, 0.0, True
        counts = ngram_counts(data)
        counts /= counts.sum()
        score = _softmax((counts @ self.table + self.bias) / self.temperature)
        best = int(score.argmax())
        strange = score[best] < self.least_score or self.known[byte_pairs(data)].mean() < self.least_known
        return self.languages[best], float(score[best]), bool(strange)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(counts: np.ndarray, pairs: list[np.ndarray], labels: list[str], epochs: int = 30, rate: float = 1.0, seed: int = 5) -> Model:
    """Fits the model to n-gram counts (rows), the pairs of bytes in each text and their languages."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    x = counts  # becomes shares in place: the sample is the largest thing that the driver holds
    x /= x.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5] if len(x) >= 50 else order
    fit = order[len(x) // 5 :] if len(x) >= 50 else order
    squares = sum((x[some] ** 2).sum(0, dtype=np.float64) for some in np.array_split(fit, max(1, len(fit) // 256)))
    scale = (1.0 / np.sqrt(squares / len(fit) + 1e-10)).astype(np.float32)  # common n-grams don't drown the others
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS))
    layer, bias = rng.normal(0, 0.1, (DIMS, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            xb = x[some] * scale
            xb /= xb.sum(1, keepdims=True)
            hidden = xb @ emb
            grad = _softmax(hidden @ layer + bias)
            grad[np.arange(len(some)), y[some]] -= 1
            grad /= len(some)
            back = grad @ layer.T
            layer -= step * hidden.T @ grad
            bias -= step * grad.sum(0) * 0.1
            emb -= step * 50 * (xb.T @ back)
    # the scaling and its norm at prediction: folded into the table as far as it is linear
    weights = scale[:, None] * (emb @ layer)
    norm = float(np.mean(x[fit] @ scale))
    known = np.zeros(1 << 16, bool)
    for i in fit:
        known[pairs[i]] = True
    model = Model(languages, weights / norm, bias, known, 1.0, 0.0, 0.0)
    logits = x[held] @ model.table + bias
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(losses, key=losses.get))
    best = _softmax(logits / model.temperature).max(1)
    model.least_score = float(min(1.05 / len(languages), np.quantile(best, 0.001)))
    model.least_known = float(min(0.9, np.quantile([known[pairs[i]].mean() for i in held], 0.001)))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Model:
    """Trains on labelled documents: those given with text, a letter and a language. Copies count once."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit("draw")))
    sizes = rows.select("lang", "h").distinct().groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(1 << 16, bool), 1.0, 0.0, 0.0)
    each = max(LEAST_TEXTS, sample // len(sizes))
    # the smallest hashes lie below a bound that well over that many of the language's texts are expected to reach
    bounds = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (1.5 * each + 50) / r["count"]) * (1 << 30))) for r in sizes], "lang string, bound long")
    place = F.pmod("h", F.lit(1 << 30))
    smallest = Window.partitionBy("lang").orderBy(place, "h")
    drawn = rows.select("lang", "h").join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("lang", "h").distinct()
    drawn = drawn.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= each).drop("r")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data, label in zip(map(letters, batch["text"]), batch["lang"]):
                if data is not None:
                    c = ngram_counts(data)  # only the counts that aren't zero travel
                    rows.append((label, np.flatnonzero(c).astype(np.int32), c[c > 0], np.unique(byte_pairs(data)).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["lang", "at", "n", "pairs"])

    found = rows.join(F.broadcast(drawn), ["lang", "h"]).dropDuplicates().mapInPandas(count, "lang string, at array<int>, n array<float>, pairs array<int>")
    # arrays come as Arrow lists, not as Python objects
    got = found.toArrow().combine_chunks()
    if not got.num_rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(1 << 16, bool), 1.0, 0.0, 0.0)
    lists = {c: got[c].combine_chunks() for c in ("at", "n", "pairs")}
    own = lambda c, i: lists[c].values[lists[c].offsets[i].as_py() : lists[c].offsets[i + 1].as_py()].to_numpy()
    labels = got["lang"].to_pylist()
    # the same rows in the same order, however the tasks ended
    order = sorted(range(len(labels)), key=lambda i: (labels[i], own("at", i).tobytes(), own("n", i).tobytes()))
    counts = np.zeros((len(labels), BUCKETS), np.float32)
    for row, i in enumerate(order):
        counts[row, own("at", i)] = own("n", i)
    return train(counts, [own("pairs", i) for i in order], [labels[i] for i in order])


def _predictor(model: Model):
    @F.pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(x) for x in texts], columns=["lang", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Sets lang_pred, score and rejected; columns of these names are replaced."""
    own = free_name(docs, "_p")
    out = docs.select("*", _predictor(model)(docs[text]).alias(own))
    return out.withColumns({"lang_pred": F.col(own)["lang"], "score": F.col(own)["score"], "rejected": F.col(own)["rejected"]}).drop(own)


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents without those that the model, trained on their labelled part, rejects."""
    model = fit_documents(docs)
    rejected = _predictor(model)(F.col("text"))["rejected"]
    return docs.where(~rejected)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
