"""Corpus pipeline: drop toxic documents, keep one of each group of near copies, redact personal data, pack into windows.

Each stage gets what the one before it wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekit.llm import packing, pii, shingle_join, toxicity
from framekit.llm.common import table
from framekit.session import cut

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the labelled ones, does not reject."""
    judged = toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter(~F.col("is_toxic")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the shingle join: the one of smallest id."""
    return shingle_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind, and their new lengths."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("personal_data", redact_personal_data), ("packing", pack)]
#: No stage can be said in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
