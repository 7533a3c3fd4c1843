"""Session and frame helpers of the text operators."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwarden.session import prepare, scratch_path, settle

__all__ = ["WORD", "batches_of", "ready", "settle", "stored", "table", "parts", "words"]
WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_ROWS = 512  # rows of a batch in Python workers; texts are long, so batches are kept small


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the text operators: those of the package, and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Smaller Arrow batches for what runs inside: for steps whose rows hold many texts each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(os.path.join(sf, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(column):
    """Words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD), F.lit(0))
