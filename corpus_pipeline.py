"""The corpus pipeline: stages over documents, each calling one operator of millrace.llm.

Each stage gets what the one before it kept. All but the last return the columns of
documents; the last returns packed pieces. Extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, lines, packing, secrets, simhash
from millrace.llm.common import bound_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: those without a letter, in a script that the labelled
    documents don't hold, or without a language likelier than a guess."""
    bound_batches(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines from the texts; every document stays."""
    return _counted(lines.drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each class of near-duplicates: texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, and what hangs together by such links."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, private keys with their bodies; every document stays."""
    bound_batches(spark)
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of power-of-two lengths: one row per piece, with its ids."""
    bound_batches(spark)
    return packing.pack_documents(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("pack", pack),
]
#: SQL has no SimHash, no tokenizer and no trained model; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
