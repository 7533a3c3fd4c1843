"""Finished work, remembered in the shared folder, so that a restart goes on where the last run ended.

An entry is a folder with one Parquet row. It is written in one job, and counts only with its ``_SUCCESS`` mark; a run that dies
half-way leaves nothing that a restart would take for finished. Names carry a fingerprint of settings and inputs, so
other settings or other rows never reuse an entry."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DONE = "_SUCCESS"


def _plain(value):
    if is_dataclass(value):
        return asdict(value)
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    return str(value)


def fingerprint(*parts) -> str:
    """A short hash of settings: numbers, texts, lists, mappings and data classes."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=_plain).encode()).hexdigest()[:16]


def content_key(df: DataFrame) -> str:
    """A fingerprint of the rows of a table, whatever their order: one pass with two sums."""
    columns = [F.to_json(F.struct(F.col(f"`{c}`"))) if kind.startswith(("map", "struct", "array")) else F.col(f"`{c}`") for c, kind in sorted(df.dtypes)]
    h = F.xxhash64(*columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 16).cast("decimal(38,0)")).alias("s")).first()
    return fingerprint(sorted(df.dtypes), row["n"], row["x"], str(row["s"]))


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _hadoop(spark, path)
    return system.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders under a path."""
    system, place = _hadoop(spark, path)
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]
    return sorted(n for n in names if exists(spark, os.path.join(path, n, DONE)))


def remove(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.delete(place, True)


class Ledger:
    """Entries under one folder: a name and a row each."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def names(self) -> set[str]:
        return set(folders(self.spark, self.path))

    def write(self, name: str, row) -> None:
        """Write or replace an entry; its mark appears last."""
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(os.path.join(self.path, name))

    def read(self) -> DataFrame:
        names = sorted(self.names())
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[os.path.join(self.path, n) for n in names])


class StepRunner:
    """Runs named steps once. A step's key is a fingerprint of its name, settings and the keys of the steps it reads.

    A step returns a table, or a mapping of plain facts (numbers, texts, lists), or writes what it makes (a model) to the folder it is given.
    ``skip`` names steps that are left out: they return None, and so do steps that need them."""

    def __init__(self, spark: SparkSession, path: str, inputs: str, skip=()):
        self.spark, self.path, self.inputs, self.skip = spark, path, inputs, set(skip)
        self.keys: dict[str, str | None] = {}
        self.ran: list[str] = []

    def folder(self, name: str) -> str:
        return os.path.join(self.path, f"{name}-{self.keys[name]}")

    def _begin(self, name, settings, needs):
        if name in self.skip or any(self.keys.get(n) is None for n in needs):
            self.keys[name] = None
            return None
        self.keys[name] = fingerprint(name, self.inputs, settings, [self.keys[n] for n in needs])
        return self.folder(name)

    def table(self, name: str, make: Callable[[], DataFrame], settings=None, needs=()) -> DataFrame | None:
        folder = self._begin(name, settings, needs)
        if folder is None:
            return None
        if not exists(self.spark, os.path.join(folder, DONE)):
            self.ran.append(name)
            make().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
        return self.spark.read.parquet(folder)

    def facts(self, name: str, make: Callable[[], Mapping], settings=None, needs=()) -> dict | None:
        def text():
            return self.spark.createDataFrame([Row(facts=json.dumps(make(), sort_keys=True))])

        found = self.table(name, text, settings, needs)
        return None if found is None else json.loads(found.first()["facts"])

    def saved(self, name: str, make: Callable[[str], None], load: Callable[[str], object], settings=None, needs=()):
        """What ``load`` reads from the folder that ``make`` wrote to; a mark beside it says that it is whole."""
        folder = self._begin(name, settings, needs)
        if folder is None:
            return None
        mark = os.path.join(folder, "whole")
        if not exists(self.spark, os.path.join(mark, DONE)):
            self.ran.append(name)
            remove(self.spark, folder)
            make(os.path.join(folder, "content"))
            self.spark.createDataFrame([Row(name=name)]).coalesce(1).write.parquet(mark)
        return load(os.path.join(folder, "content"))
