"""Corpus pipeline: stages that each write a table which the next one reads.

quality keeps the documents that the classifier predicts to be good, simhash one document of each group of
near-duplicates, decontamination those that hold no benchmark passage; mixing repeats or drops documents until
the sources have their target weights, and tokens writes the store of token ids and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, mixing, quality, simhash, tokenstore
from tessella.llm.common import stored, table
from tessella.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("simhash", near_duplicates), ("decontamination", benchmark_passages), ("mixing", source_mix), ("tokens", token_store)]
#: A classifier that is fitted and near-duplicates that are linked transitively are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents after all stages: a row of the token store for each document of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
