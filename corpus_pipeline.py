"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of
documents; what a stage returns is written and read again as the next one's docs. Every stage takes
nulls in any column, repeated rows, empty tables and columns beside those of documents (which go).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adaptlm.llm.mixing import mixed_documents
from adaptlm.llm.neardup import one_of_each
from adaptlm.llm.packing import pack_digests
from adaptlm.llm.quality import scored, train
from adaptlm.llm.shared import written
from adaptlm.llm.suffixes import deduplicated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, trained on the table labels, does not reject. Null and empty texts are scored as texts without words."""
    docs = docs.select(*COLUMNS)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).where(F.col("predicted") == 1).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null ids last. Texts without words are alike to nothing and stay."""
    return one_of_each(docs, COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes or more that repeat anywhere; a null text becomes empty, n_chars is what is left."""
    return deduplicated(docs, COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the target proportions: a row for each time that the mix takes a document. Documents without words are never taken.

    Documents weigh by the quality model, which learns from the whole texts of the table documents.
    """
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed_documents(docs, COLUMNS, model)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens, in which the sources keep the proportions of the mix. An empty text is its end token alone."""
    return pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: The stages hold trained models and byte-exact tokens, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result but the last is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
