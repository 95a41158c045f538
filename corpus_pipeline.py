"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, with the columns of documents,
and gives the same columns; the last gives packed pieces with their token ids.

Null and empty texts are clean, equal to each other (one stays), near to nothing,
and have no words to mix, so none of them is packed unless it comes to the last stage alone.
Null ids, languages and sources are values like others. Rows that repeat are judged by their texts
until exact deduplication leaves one. Ties go to ids, then to hashes of texts. An empty
table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import Scratch
from textloom.llm.exact_dedup import keep_one_of_each_text
from textloom.llm.mixing import Mixture
from textloom.llm.near_dedup import keep_one_of_each_component
from textloom.llm.packing import pack_documents
from textloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. The chain learns from those of ``labels`` that are among ``docs``."""
    return without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return keep_one_of_each_text(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id stays."""
    return keep_one_of_each_component(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' words in the target proportions: documents come as often as their words are drawn, up to three times."""
    return Mixture(spark, docs).documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document."""
    return pack_documents(spark, docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Models, hashes and tokenizers decide here; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
