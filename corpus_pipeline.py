"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept; its result is written as
Parquet and read again as the next stage's documents.  Texts are whole in every
stage, whatever their length; further columns pass through, whatever their names;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convlake.llm import decontaminate, langid, packing, secrets, simhash
from convlake.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; texts without letters or in no such language go.

    Null and empty texts go.  Rows with null or repeated doc_id, and repeated rows,
    are judged like others.
    """
    return langid.keep_known(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Null and empty texts are a group of their own.  Rows without a doc_id come
    last; of rows with one doc_id and near texts one is kept, by a hash; of repeated
    rows one.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts, of documents and of items, are never found.  Repeated rows
    go or stay together; rows that share a doc_id are told apart by their texts.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows the text.

    Null and empty texts stay as they are, and so do all rows.
    """
    return secrets.Scanner(spark).mask(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences.

    A null or empty text is its end id alone.  Repeated rows and rows without a
    doc_id are packed like others; pieces that tie are alike.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("sequence_packing", sequence_packing),
]

#: Fingerprints, filters learned from the corpus and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
