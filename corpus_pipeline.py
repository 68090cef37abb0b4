"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing and packing, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfind.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from wayfind.llm.common import Scratch, file_count
from wayfind.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.good_documents(docs).coalesce(file_count(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows."""
    return line_dedup.without_repeated_lines(docs).coalesce(file_count(docs))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs).coalesce(file_count(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, 0 to 2 times."""
    return mixing.mixed_documents(docs).coalesce(file_count(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path()).coalesce(file_count(docs))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", unique), ("mixing", mixed), ("packing", packed)]

#: The stages' estimates, components and packing are no SQL: tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs
