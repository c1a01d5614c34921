"""Corpus preparation: documents through rejecting, deduplicating and packing stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, language, severity, vector_packing
from tidemark.llm.common import dealt, shared_path, staged, table
from tidemark.llm.matrices import WRITTEN, pieces_of

SURE = 0.3  # corrected share of a text's n-grams that its language must hold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted severity is more likely above 0 than not go; null texts stay."""
    model = severity.model_for(docs, table(spark, sf_dir, "labels"))
    return severity.predict(dealt(docs), model).where(F.col("p_toxic") < severity.TOXIC).select(*docs.columns)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose text is in none of the corpus's languages, go.

    The filters are learned from the documents' own languages; where no document has one, all stay.
    """
    filters = language.learn(docs)
    if not filters.languages:
        return docs
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)
    return language.predict(dealt(docs), filters).where(known).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, read back from the written matrices."""
    return pieces_of(staged(vector_packing.pack_documents(docs), "packed", **WRITTEN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None  # tokenizers, trained models and shingle joins are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
