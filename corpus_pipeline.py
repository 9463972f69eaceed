"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns that it got, whatever their names; an empty
table gives an empty one. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.buffers import discard, documents, durable
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.jaccard_join import first_of_groups
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.packing import pack
from plumbline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored by the
    intercept; rows that repeat are judged alike."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest doc_id, once
    if it repeats. A null text is equal to an empty one; a row without doc_id stays only if no
    equal row has one."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.
    Texts without words and rows without doc_id stay, and so does a text that shares its
    doc_id with another's near copy."""
    return first_of_groups(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words aren't taken.
    Rows that repeat doc_id, source and text share the largest of their counts."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences; every row is packed, a null or empty text as
    its end token."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("source_mixing", source_mix),
    ("packing", packing),
]

# The classifier and the tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all of `documents`. Each stage's result is written
    to the shared folder, as the next stage reads its documents more than once."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, durable(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
