"""The corpus pipeline: stages from documents to a mix, each written as Parquet and read again by the next."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from editwarden.llm.frames import ready, stored
from editwarden.llm.languages import with_language
from editwarden.llm.leaks import without_leaks
from editwarden.llm.lines import line_dedup
from editwarden.llm.mixing import mixed
from editwarden.llm.near import without_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    ready(spark)
    return with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted from the texts; documents of which nothing is left go."""
    ready(spark)
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ready(spark)
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return without_leaks(docs, ready(spark).read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of copies and the words taken."""
    ready(spark)
    return mixed(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]
# SQL can express neither the trained classifier nor the knapsack; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
