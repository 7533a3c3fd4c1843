"""Joins on keys. Sizes decide how a join runs; nothing here forces a broadcast.

Spark broadcasts a side whose file or shuffle size is under its threshold, and adaptive
execution splits the partitions of hot keys otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "changeset_id"


def join_labels(changesets: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    return changesets.join(labels, key)


def split_like(features: DataFrame, labels: DataFrame, split_ids: DataFrame, key: str = KEY) -> DataFrame:
    """Features with label, routed to the split that the ids already have."""
    return features.join(labels, key).join(split_ids.select(key, "split"), key)


def missing_ids(split_ids: DataFrame, features: DataFrame, key: str = KEY, examples: int = 10) -> DataFrame:
    """Per split the number of ids without features, and the lowest of them as examples."""
    absent = split_ids.join(features.select(key), key, "left_anti")
    counts = absent.groupBy("split").agg(F.count(F.lit(1)).alias("missing"))
    # each task keeps its lowest ids per split before the shuffle
    nth = F.row_number().over(Window.partitionBy("split").orderBy(key))
    lowest = absent.withColumn("_nth", nth).where(F.col("_nth") <= examples).groupBy("split").agg(
        F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",").alias("examples"))
    return counts.join(lowest, "split")


def require_ids(split_ids: DataFrame, features: DataFrame, key: str = KEY) -> None:
    problems = missing_ids(split_ids, features, key).collect()
    if problems:
        raise ValueError("ids without features: " + "; ".join(f"{p['split']}: {p['missing']} ({p['examples']})" for p in problems))


def label_conflicts(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    both = a.select(key, F.col("y_true").alias("y_true_a")).join(b.select(key, F.col("y_true").alias("y_true_b")), key)
    return both.where("y_true_a <> y_true_b")


def require_same_labels(a: DataFrame, b: DataFrame, key: str = KEY) -> None:
    example = label_conflicts(a, b, key).limit(1).collect()
    if example:
        raise ValueError(f"labels differ, for example for {key} {example[0][key]}")


def stack_inputs(main: DataFrame, hyper: DataFrame, key: str = KEY) -> DataFrame:
    """One row per changeset with both probabilities and one label."""
    return main.select(key, "y_true", "y_prob_main").join(hyper.select(key, "y_prob_hyper"), key)


def meta_scores(main: DataFrame, hyper: DataFrame, meta: DataFrame, key: str = KEY) -> DataFrame:
    """Scores of all three models on the changesets of the meta test set."""
    rows = stack_inputs(main, hyper, key).join(meta.select(key, "y_prob_meta"), key)
    return rows.withColumns({
        f"y_pred_{m}": (F.col(f"y_prob_{m}") >= 0.5).cast("int") for m in ("main", "hyper", "meta")})


def audit_labels(computed: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """Label computed from the edits beside the original one, with a flag where they differ."""
    from editwarden.functions.texts import yes_no
    both = computed.select(key, F.col("vandalism").alias("computed_vandalism")).join(
        labels.select(key, yes_no(F.col("label")).alias("original_vandalism")), key)
    return both.withColumn("discrepancy", ~F.col("computed_vandalism").eqNullSafe(F.col("original_vandalism")))


def by_region(df: DataFrame, regions: str, name: str = "region") -> DataFrame:
    """One row per (row, region it lies in); rows without a region are left out.

    The outer explode keeps Spark from computing the list a second time in an inferred filter."""
    rows = df.withColumn(name, F.explode_outer(regions)).where(F.col(name).isNotNull())
    return rows.drop(*([regions] if regions != name else []))


def diff_tables(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells that differ between two tables with the same unique key, as text.

    A row on one side only shows up with all its values against null, its key included."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    def side(df, mark):
        return df.select(*[F.col(k).alias(f"{k}_{mark}") for k in key],
                         *[F.col(c).cast("string").alias(f"{c}_{mark}") for c in shared], F.lit(True).alias(f"_{mark}"))

    on = None
    for k in key:
        same = F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))
        on = same if on is None else on & same
    both = side(a, "a").join(side(b, "b"), on, "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    cells = [
        F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")),
               F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("value_a"), F.col(f"{c}_b").alias("value_b")))
        for c in shared
    ]
    cells.append(F.when(one_sided, F.struct(
        F.lit("<row>").alias("column"), F.when(F.col("_a"), "present").alias("value_a"),
        F.when(F.col("_b"), "present").alias("value_b"))))
    keys = [F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in key]
    found = both.select(*keys, F.explode_outer(F.array_compact(F.array(*cells))).alias("_c"))
    return found.where("_c IS NOT NULL").select(*key, "_c.*")


def diff_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns on one side only, types that differ, and the numbers of rows."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    rows = [("only_a", c, left[c], None) for c in left if c not in right]
    rows += [("only_b", c, None, right[c]) for c in right if c not in left]
    rows += [("type", c, left[c], right[c]) for c in left if c in right and left[c] != right[c]]
    facts = a.sparkSession.createDataFrame(rows, "fact string, column string, a string, b string")
    count = F.count(F.lit(1)).cast("string")
    none = F.lit(None).cast("string")
    sizes = a.agg(count.alias("a")).withColumn("b", none).unionByName(b.agg(count.alias("b")).withColumn("a", none))
    sizes = sizes.agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return facts.unionByName(sizes.select(F.lit("rows").alias("fact"), none.alias("column"), "a", "b"))
