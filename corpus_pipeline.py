"""From documents to packed training sequences, in four stages.

Each stage is (name, function of spark, docs and the folder of the tables); its result is written
as Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.langid import in_known_language, learn
from plumbline.llm.pii import replace_entities
from plumbline.llm.queries import packed
from plumbline.llm.shared import shared_path, table
from plumbline.llm.simhash import keep_one_of_each

#: Documents stay if at least this share of their positions reads as languages that the labelled ones
#: teach. Low, so that a few words between numbers and tokens, which read as strange, are kept.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; their own label is not looked at."""
    return in_known_language(docs, learn(docs, others=True), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return keep_one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by surrogates; no document goes."""
    return replace_entities(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences of up to 1024 tokens."""
    return packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("packing", packing),
]
#: Neither the network's labels nor the packing can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
