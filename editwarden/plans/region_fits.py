"""One model for every way to assign regions to training, validation and test.

Features are put into one vector and written once, in a folder for each set of regions, which is a number with a bit for each region. A combination
is then three filters on that table: no split is ever written, and each reads the folders of its own regions only. Fits run a few at a time, fewer
where the learner would hold more than ROWS_HELD rows; each writes its counts to a ledger as it ends, and a restart fits only what is missing."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwarden.functions.places import CONTINENTS
from editwarden.operators.metrics import with_metrics
from editwarden.operators.models import assembled, fit_trees, score
from editwarden.operators.regions import region_groups
from editwarden.plans.ledger import Ledger, content_key, exists, fingerprint

COUNTS = "combination int, n_train bigint, n_val bigint, n_test bigint, TN bigint, FP bigint, FN bigint, TP bigint, rounds int, error string"
MOST_REGIONS = 62
# Rows that the fits which run side by side hold at most (one fit may need more). The learner keeps some 200 bytes a row and writes to disk what does not fit.
ROWS_HELD = 20_000_000


def region_bits(column: str | Column, regions: Sequence[str]) -> Column:
    """The regions of a list column as bits of one number; regions not listed leave no bit."""
    if len(regions) > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions")
    bits = F.lit(0).cast("bigint")
    for i, region in enumerate(regions):
        bits = bits + F.when(F.array_contains(column, region), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return F.coalesce(bits, F.lit(0).cast("bigint"))


def _mask(group: Sequence[str], regions: Sequence[str]) -> int:
    return sum(1 << regions.index(r) for r in group)


def _within(mask: int) -> Column:
    return F.col("_bits").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def fit_combination(rows: DataFrame, masks: tuple[int, int, int], params: Mapping, label: str, threshold: float) -> dict:
    """Fit on the training regions, stop on the validation regions, count on the test regions.

    A row of several groups goes to each of them, like in the geographic split."""
    train, val, test = masks
    side = lambda mask, held: rows.where(_within(mask)).select("_features", label, F.lit(held).alias("_validate"))
    # the learner asks for one side at a time: of a union Spark then reads that side only
    learn = side(train, False).unionByName(side(val, True))
    model = PipelineModel([fit_trees(learn, params, label, store=False)])
    tested = score(rows.where(_within(test)).select("_features", label), model)
    hit = F.col("y_prob") >= threshold
    cells = tested.agg(*[F.count_if((F.col(label) == t) & (hit if p else ~hit)).alias(n) for n, t, p in (("TN", 0, 0), ("FP", 0, 1), ("FN", 1, 0), ("TP", 1, 1))],
                       F.count(F.lit(1)).alias("n_test")).first().asDict()
    sizes = rows.agg(F.count_if(_within(train)).alias("n_train"), F.count_if(_within(val)).alias("n_val")).first().asDict()
    return cells | sizes | {"rounds": len(model.stages[-1].trees)}


def _side_by_side(rows: DataFrame, parallel: int) -> int:
    """How many fits run at a time: each holds no more than all rows twice, as training and as validation rows."""
    return max(1, min(parallel, ROWS_HELD // max(1, rows.count())))


def fit_combinations(
    df: DataFrame, features: Sequence[str], params: Mapping, folder: str, label: str = "vandalism", region_column: str = "continents",
    regions: Sequence[str] = CONTINENTS, low: int = 2, high: int = 3, threshold: float = 0.5, parallel: int = 4,
    fit: Callable = fit_combination,
) -> DataFrame:
    """Counts and metrics of every combination, one fitted model each.

    ``folder`` keeps the encoded rows and the ledger, under a fingerprint of the settings and of the rows. A combination
    that cannot be fitted is reported with its error and tried again by the next run."""
    spark = df.sparkSession
    regions = list(regions)
    rows = df.select(*[F.col(f"`{c}`") for c in features], label, region_bits(region_column, regions).alias("_bits")).where("_bits <> 0")
    base = os.path.join(folder, fingerprint(list(features), dict(params), label, regions, threshold, content_key(rows)))
    encoded = os.path.join(base, "by_regions")
    rows = assembled(rows, features).select("_features", label, "_bits")
    if not exists(spark, os.path.join(encoded, "_SUCCESS")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bits").parquet(encoded)
    rows = spark.read.schema(rows.schema).parquet(encoded)
    groups = region_groups(regions, low, high)
    # named by the regions, so that runs over other sizes share what they have in common
    names = {"-".join(str(_mask(g, regions)) for g in three): (i + 1, three) for i, three in enumerate(groups)}
    ledger = Ledger(spark, os.path.join(base, "fits"), COUNTS)
    failed = {}

    def work(name):
        number, three = names[name]
        try:
            found = fit(rows, tuple(_mask(g, regions) for g in three), params, label, threshold)
        except Exception as error:  # the others go on
            failed[name] = f"{type(error).__name__}: {str(error)[:500]}"
            warnings.warn(f"combination {three}: {failed[name]}", stacklevel=2)
            return
        ledger.write(name, [number, *(found[c] for c in ("n_train", "n_val", "n_test", "TN", "FP", "FN", "TP", "rounds")), None])

    missing = [n for n in names if n not in ledger.names()]
    with ThreadPoolExecutor(max_workers=_side_by_side(rows, parallel)) as pool:
        list(pool.map(inheritable_thread_target(spark)(work), missing))
    schema = "combination int, train_regions array<string>, val_regions array<string>, test_regions array<string>, _name string, _error string"
    combos = spark.createDataFrame([(i, *map(list, three), name, failed.get(name)) for name, (i, three) in names.items()], schema)
    counts = ledger.read().withColumn("_entry", F.element_at(F.split(F.input_file_name(), "/"), -2)).drop("combination", "error")
    full = combos.join(counts, F.col("_name") == F.col("_entry"), "left").withColumn("error", F.col("_error"))
    return with_metrics(full.drop("_name", "_entry", "_error"))
