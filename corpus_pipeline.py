"""The stages that make training sequences of raw documents, each by one operator of veridex.llm.

Every stage but the last returns the columns of its input, whatever these are called; each works on all rows that the one before
kept, and an empty table passes through all of them. Rows with a null or empty text fail the quality rules. Copies, near copies and
repeated rows leave one row: that of the least doc_id, nulls last; of equal ids that of the least text by hash. Ties elsewhere go by
doc_id. Very long texts are taken whole in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridex.llm import decontaminate, near_dup, packing, pii, quality_rules
from veridex.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class; rows without words, which the rules drop, would all stay."""
    return near_dup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with surrogates for personal data and secrets."""
    return pii.replaced(docs, pii.session_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece; null doc_ids are carried."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(packing.VOCABULARY)))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("packing", packed)]

#: DartMinHash, WAND, the tokenizer and the local search are no SQL; tests/llm compares the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
