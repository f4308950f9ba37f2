"""From documents to packed training sequences, in five stages.

Language ID rejects documents without a recognised language; line dedup deletes
later copies of repeated line runs; MinHash keeps one document of each group of
near-duplicates; passages of 35 or more words that occur elsewhere are removed;
what is left is packed into sequences. Every stage reads all that its
predecessor kept. All but the last return the columns of ``documents``, with
``n_chars`` of the text that is left. An empty table goes through all stages as an
empty one; columns beside ``doc_id``, ``text``, ``lang`` and ``n_chars`` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import cleaning, retrieval_packing
from tracklake.llm.common import saved

#: How far a document's score must be from an even split over the learned languages, on the way to certainty.
LEAST_MARGIN = 0.067


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language. Null texts and those without a letter go; repeated ids are judged row by row."""
    return cleaning.with_language(docs, LEAST_MARGIN)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; documents that only repeat others go. Null and blank texts stay as they are; of equal runs the one with the least id, then line, stays."""
    return cleaning.without_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, likeness 0.8. The least id stays; null and blank texts are alike to none."""
    return cleaning.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of repeated 35-word passages; documents of nothing else go. Null and shorter texts stay as they are."""
    return cleaning.without_repeated_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null text is its separator alone."""
    return retrieval_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("passage_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Trained networks and iterated components are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
