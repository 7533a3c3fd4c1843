"""Set operations on tables and summary upserts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.functions.texts import percentage_text

SUMMARY = ("month", "total_entries", "vandalism_count", "vandalism_percentage")


def union_all(tables: Iterable[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), tables)


def common_ids(*tables: DataFrame, key: str = "changeset_id") -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [t.select(key) for t in tables])


def id_overlap(a: DataFrame, b: DataFrame, key: str = "changeset_id") -> DataFrame:
    """Every id of either table with the place where it was found: both, only_a or only_b."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    # the partial aggregate removes repeated ids before the shuffle
    seen = sides.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    where = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "only_a").otherwise("only_b")
    return seen.select(key, where.alias("found"))


def remaining(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return df.join(sample.select(key), key, "left_anti")


def upsert_summary(old: DataFrame, new: DataFrame, mode: str = "replace") -> DataFrame:
    """Month summary after a run: months are replaced, or counts are added and percentages renewed."""
    stamps = ["updated_at"] if "updated_at" in new.columns else []
    if stamps and "updated_at" not in old.columns:
        old = old.withColumn("updated_at", F.lit(None).cast("timestamp"))
    old, new = old.select(*SUMMARY, *stamps), new.select(*SUMMARY, *stamps)
    if mode == "replace":
        return old.join(new.select("month"), "month", "left_anti").unionByName(new)
    if mode != "add":
        raise ValueError(f"unknown mode {mode}")
    total, bad = F.sum("total_entries"), F.sum("vandalism_count")
    return old.unionByName(new).groupBy("month").agg(
        total.alias("total_entries"), bad.alias("vandalism_count"), percentage_text(bad, total).alias("vandalism_percentage"), *[F.max(s).alias(s) for s in stamps])


def describe_schema(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)], "position int, column string, type string")
