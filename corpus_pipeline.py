"""A training corpus from raw documents: language ID, exact dedup, near dedup, source mix, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all its predecessor kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Defined cases. A null or empty text, or one without a letter, goes in the first stage, as its language can't be told; a
null lang is filled with the predicted one. A row without an id takes part: null ids never make two texts one. Rows
repeated whole are copies, so one stays; of linked documents with equal ids all rows of the smallest id stay. A null
source is a source, the last one. Very long texts are read whole by every stage and cut into pieces by the last alone.
Ties go to the larger doc_id among copies, to the smaller among near copies. Further columns, whatever their names, are
carried to the last stage, which returns its own columns. Empty documents give an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixtura.llm import exact_dedup, language_id, mixing, ngram_join, packing
from fixtura.llm.common import read_table, settle
from fixtura.llm.queries import CAPACITY, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return language_id.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY)


STAGES = [("language_id", identify_language), ("exact_dedup", dedup_exact), ("ngram_jaccard", dedup_near), ("source_mix", mix), ("best_fit_packing", pack)]

#: The classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
