"""From raw documents to packed training sequences: each stage is one corpus operator over all that its predecessor kept.

Every stage but the last returns the columns of documents. Null texts score, link, redact, mix and pack as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import jaccard, mixing, packing, pii, quality
from geoloom.llm.common import documents
from geoloom.storage import discard, materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted to the labels of documents not held out, rejects go.

    Null text scores as empty; rows that repeat are scored each; without labels of both kinds all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles are 0.8 similar or more, the least id stays.

    Null and empty texts are similar to nothing; rows of one id stay together; a null id stays.
    """
    return jaccard.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind's name; n_chars follows the text. A null text, and its n_chars, stay."""
    return pii.redact(docs, pii.fit(spark)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their targets: documents stay, repeat or go. A null source is one of its own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences. A null text is an empty document; an empty table gives no piece."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", good_documents), ("n-gram Jaccard join", one_of_each), ("PII", without_personal_data), ("mixing sources", mixed), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
