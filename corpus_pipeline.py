"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import language, quality
from statloom.llm.common import table, written
from statloom.llm.jaccard import one_of_each
from statloom.llm.packing import pack_documents
from statloom.llm.passages import repeated_passages, without_passages


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores at least 0.3; it learns from the labels of the folder."""
    return quality.keep_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network tells with a score of at least 0.4."""
    return language.keep_documents(docs, language.train(docs), 0.4)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    return one_of_each(docs, 5, (80, 100))


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that repeat an earlier document's; one of which nothing is left goes."""
    cut = without_passages(docs, repeated_passages(docs))
    left = cut.where(F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, neighbours along the Hilbert curve together."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("language ID", known_languages),
    ("n-gram Jaccard join", distinct_documents),
    ("substring dedup", distinct_passages),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
