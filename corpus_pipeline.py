"""Corpus pipeline: from raw documents to encoded training sequences.

Every stage takes an empty table to an empty result, reads texts of any length
whole, treats rows that repeat as rows of their own unless it removes copies, and
passes on further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import bpe, exact_dedup, langid, mixing, near_dup
from stratalens.llm.common import materialize
from stratalens.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the language model finds a language; texts without a letter, or of no clear language, go.

    The model learns from the labelled rows of ``docs`` themselves. With four
    languages chance gives a score of 0.25; what lies below 0.3 is rejected. Null and
    empty texts have no letter and go; rows with null lang or doc_id are judged by
    their text like all others.
    """
    return langid.keep_identified(docs, langid.train(docs), least=0.3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id, null ids last, ties by place; null equals empty."""
    return exact_dedup.keep_one(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts: that of the smallest doc_id, null ids last, ties by place.

    Texts without words (null, empty, white space) all stay.
    """
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per document and pass over its source, with the words taken, by shard and place.

    Null is a source of its own, the last; null and empty texts hold no words, so no pass takes them.
    """
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text they decode to; null and empty texts have none and an empty one."""
    return bpe.bpe_encode(docs, tokenizer_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", mix),
    ("BPE", encode),
]

#: The stages learn a model, sign shingles and encode: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
