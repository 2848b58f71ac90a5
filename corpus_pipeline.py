"""Corpus preparation: good documents, one of each group of near copies, without benchmark passages, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import decontaminate, jaccard, packing, quality
from tideglass.llm.queries import SEQUENCE, vocabulary
from tideglass.llm.scratch import Scratch, used_up


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier doesn't reject, repeated ones too.

    Null and empty texts are scored as any. Without usable labels every score is 0.5, so all rows go. Columns of
    ``docs`` other than ``doc_id`` and ``text`` go along as they are.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of the n-gram Jaccard join reach, the one of the smallest id.

    Rows with one id and one text are one; of several texts of that id, that of the smallest hash stays. Rows without
    words are copies of nothing. A null id comes after all others.
    """
    return jaccard.one_of_each_group(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't contaminated by benchmark items, repeated ones too; those without words stay. An empty benchmark rejects nothing."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences. A null or empty text is one token; repeated rows are packed as often."""
    return packing.pack_documents(docs, vocabulary(), SEQUENCE)


STAGES = [("quality", good_quality), ("jaccard", one_of_each_group), ("decontamination", without_benchmarks), ("packing", packed)]
#: SQL can't express the classifier and the tokenizer; ``tests/llm/test_pipeline.py`` has every stage again in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. Empty tables give an empty result."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with used_up():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
