"""Every way to assign regions to training, validation and test, and the results of each."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwarden.functions.places import CONTINENTS
from editwarden.operators.metrics import confusion, with_metrics


def region_groups(regions: Sequence[str] = CONTINENTS, low: int = 2, high: int = 3):
    """(train, val, test) for all group sizes from ``low`` to ``high`` that use up the regions."""
    found = []
    for n_train in range(low, high + 1):
        for n_val in range(low, high + 1):
            if not low <= len(regions) - n_train - n_val <= high:
                continue
            for train in combinations(regions, n_train):
                rest = [r for r in regions if r not in train]
                for val in combinations(rest, n_val):
                    found.append((train, val, tuple(r for r in rest if r not in val)))
    return found


def region_combinations(spark: SparkSession, regions: Sequence[str] = CONTINENTS, low: int = 2, high: int = 3) -> DataFrame:
    """The same as a table; its size depends on the number of regions only."""
    rows = [(i + 1, list(a), list(b), list(c)) for i, (a, b, c) in enumerate(region_groups(regions, low, high))]
    schema = "combination int, train_regions array<string>, val_regions array<string>, test_regions array<string>"
    return spark.createDataFrame(rows, schema)


def geo_combo_report(df: DataFrame, regions: str = "continents", combos: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Confusion counts and metrics of the test regions of each combination.

    A row in several test regions counts once. Rows are first counted per set of regions, so the
    combinations meet at most 2^regions rows, whatever the size of the table. ``model`` names a
    column with the combination whose model made the prediction; without it all share one."""
    combos = region_combinations(df.sparkSession) if combos is None else combos
    by = ["_set"] + (["_made_by"] if model else [])
    rows = df.withColumn("_set", F.sort_array(regions))
    if model:
        rows = rows.withColumn("_made_by", F.col(model))
    counts = confusion(rows, by)
    tests = combos.select("combination", F.explode("test_regions").alias("_region"))
    same = F.col("_region") == F.col("_member")
    if model:
        same = same & (F.col("combination") == F.col("_made_by"))
    pairs = counts.select("*", F.explode("_set").alias("_member")).join(tests, same)
    once = pairs.dropDuplicates(["combination", *by])
    cells = ("TN", "FP", "FN", "TP")
    sums = once.groupBy("combination").agg(*[F.sum(c).alias(c) for c in cells])
    full = combos.join(sums, "combination", "left").fillna(0, list(cells))
    return with_metrics(full)
