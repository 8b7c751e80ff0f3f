"""The corpus pipeline: stages over documents, each written and read again by the next.

1. quality: documents that the quality classifier scores under 0.5 go.
2. near_dedup: of each group of near duplicates (sets of five-word shingles of Jaccard similarity 0.8 or more), the document with the smallest doc_id stays.
3. suffix_dedup: texts lose every byte covered by a string of 200 bytes that occurs twice; all documents stay.
4. mixing: sources are brought to their target weights; a document may go, or stay up to three times, whole or in part.
5. tokens: SentencePiece ids of every text, decoded again and compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import mixing, near_copies, pieces, quality, suffix_dedup
from flowloom.llm.common import table, written
from flowloom.llm.toxicity import is_training


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", is_training(3, 1))
    return quality.good_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenized(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_array_dedup),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

ORACLE_SQL = None  # hashes, a trained network and Viterbi have no SQL; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
