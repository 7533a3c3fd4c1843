"""Counts, distributions and per-changeset score profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwarden.functions import places, texts
from editwarden.functions.times import month_label
from editwarden.operators.running import running, split_hot

# Largest group whose distinct values one task may hold for exact quantiles.
QUANTILE_ROWS = 250_000
PROFILE_QUANTILES = {"quantile_25": 0.25, "median_prediction": 0.5, "quantile_75": 0.75}


def class_counts(df: DataFrame, label: str = "vandalism") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def split_stats(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    total, bad = F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))
    return df.groupBy(split).agg(
        total.alias("total"), bad.alias("vandalism"), (total - bad).alias("non_vandalism"),
        F.coalesce(F.try_divide(bad.cast("double"), total), F.lit(0.0)).alias("ratio"))


def split_shapes(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(features)).cast("bigint").alias("columns"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], limit: int | None = QUANTILE_ROWS,
) -> DataFrame:
    """Exact quantiles (linear between neighbours) per group.

    Ordinary groups use the built-in aggregate, which holds a group's distinct values in one
    task. Groups above ``limit`` rows are reduced to (value, count); their quantiles are the
    values at which the running count passes the wanted ranks."""
    df = df.where(F.col(value).isNotNull())
    cold, hot = (df, None) if limit is None else split_hot(df, by, limit)
    parts = []
    if cold is not None:
        wanted = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(q)) for q in quantiles.values()]))
        held = cold.groupBy(*by).agg(wanted.alias("_q"))
        parts.append(held.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(quantiles)]))
    if hot is not None:
        counts = hot.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        ranked = running(counts, list(by), ["_v"], sums={"_upto": F.col("_n")}, totals={"_all": F.col("_n")}, limit=limit)
        first = F.col("_upto") - F.col("_n")  # rank of the first row with this value, from 0

        def at(rank: Column) -> Column:
            return F.max(F.when((rank >= first) & (rank < F.col("_upto")), F.col("_v")))

        spots = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
        ends = ranked.groupBy(*by).agg(F.max("_all").alias("_all"), *[
            c for name, spot in spots.items()
            for c in (at(F.floor(spot)).alias(f"_low_{name}"), at(F.ceil(spot)).alias(f"_high_{name}"))])
        parts.append(ends.select(*by, *[
            (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (spot - F.floor(spot))).alias(n)
            for n, spot in spots.items()]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def score_profile(df: DataFrame, by: str = "changeset_id", score: str = "predicted_prob", limit: int | None = QUANTILE_ROWS) -> DataFrame:
    """Fourteen figures about the scores of each changeset; 0 where a figure is undefined."""
    s = F.col(score)
    high = (s > 0.5).cast("int")
    figures = [
        F.count(s).alias("num_contributions"),
        F.avg(s).alias("mean_prediction"),
        F.stddev_samp(s).alias("std_prediction"),
        F.min(s).alias("min_prediction"),
        F.max(s).alias("max_prediction"),
        F.skewness(s).alias("skewness_prediction"),
        F.kurtosis(s).alias("kurtosis_prediction"),
        (F.sum(F.coalesce(high, F.lit(0))) / F.count(F.lit(1))).alias("proportion_vandalism"),
        F.sum(F.coalesce(high, F.lit(0))).alias("num_vandalism_predictions"),
        F.max(F.coalesce(high, F.lit(0))).alias("any_vandalism_prediction"),
        F.min(F.coalesce(high, F.lit(0))).alias("all_vandalism_predictions"),
    ]
    cold, hot = (df, None) if limit is None else split_hot(df, [by], limit)
    parts = []
    if cold is not None:
        wanted = F.percentile(s, F.array(*[F.lit(q) for q in PROFILE_QUANTILES.values()]))
        held = cold.groupBy(by).agg(*figures, wanted.alias("_q"))
        held = held.withColumns({name: F.col("_q")[i] for i, name in enumerate(PROFILE_QUANTILES)})
        parts.append(held.drop("_q"))
    if hot is not None:
        quantiles = exact_quantiles(hot, [by], score, PROFILE_QUANTILES, limit)
        plain = hot.groupBy(F.col(by).alias("_by")).agg(*figures)
        parts.append(plain.join(quantiles, F.col("_by").eqNullSafe(F.col(by)), "left").drop("_by"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # moments of equal scores are undefined; NaN appears when rounding leaves a tiny variance
    names = [c for c in rows.columns if c != by]
    return rows.select(by, *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)) if "ness" in c or "kurt" in c else F.col(c), F.lit(0)).alias(c) for c in names])


def edits_per_changeset(df: DataFrame, by: str = "changeset_id", top: int | None = None) -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), by).limit(top)


def describe_counts(df: DataFrame, by: str = "changeset_id") -> DataFrame:
    """Distribution of the group sizes.

    Sizes are counted per size first: groups that add up to N rows have at most sqrt(2N)
    different sizes, so the final aggregate stays small."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("times"))
    n, times = F.col("n").cast("double"), F.col("times")
    q = F.expr("percentile(CAST(n AS DOUBLE), array(0.25D, 0.5D, 0.75D), times)")
    total, whole, squares = F.sum(times), F.sum(n * times), F.sum(n * n * times)
    deviation = F.sqrt(F.try_divide(squares - whole * whole / total, total - 1))
    return sizes.agg(
        (whole / total).alias("mean"), q.alias("_q"), deviation.alias("std"), F.max("n").alias("max"), F.min("n").alias("min"),
    ).select("mean", F.col("_q")[1].alias("median"), "std", "max", "min", F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Rows per bin of equal width; the last bin includes its upper edge, values outside are left out."""
    x = F.col(column).cast("double")
    bucket = F.least(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)) - 1
    return df.where(x.between(low, high)).groupBy(bucket.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def changeset_labels(df: DataFrame, by: str = "changeset_id", label: str = "vandalism") -> DataFrame:
    """Per changeset the number of different labels and yes if any edit is harmful."""
    bad = F.col(label).cast("boolean")
    return df.groupBy(by).agg(
        (F.coalesce(F.max(bad.cast("int")), F.lit(0)) + F.coalesce(F.max((~bad).cast("int")), F.lit(0))
         + F.max(bad.isNull().cast("int"))).cast("bigint").alias("n_labels"),
        F.when(F.coalesce(F.bool_or(bad), F.lit(False)), "yes").otherwise("no").alias("vandalism"))


def mixed_changesets(df: DataFrame, by: str = "changeset_id", label: str = "vandalism") -> DataFrame:
    return changeset_labels(df, by, label).where("n_labels > 1")


def label_totals(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("vandalism").agg(F.count(F.lit(1)).alias("n"))


def monthly_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(month_label(F.col(ts)).alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def monthly_summary(df: DataFrame, month: str = "month", pred: str = "y_pred") -> DataFrame:
    """Edits, flagged edits and percentage per month."""
    total, bad = F.count(F.lit(1)), F.sum(F.col(pred).cast("bigint"))
    return df.groupBy(month).agg(
        total.alias("total_entries"), bad.alias("vandalism_count"),
        texts.percentage_text(bad, total).alias("vandalism_percentage"))


def heat_cells(df: DataFrame, ts: str, size: float, x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """Edits per month and grid cell."""
    cell = places.grid_cell(F.col(x), F.col(y), size)
    return df.groupBy(month_label(F.col(ts)).alias("month"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def importance_table(tables: Sequence[DataFrame]) -> DataFrame:
    """One row per feature from (feature, metric value) tables with different metric columns."""
    union = tables[0]
    for more in tables[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    metrics = [c for c in union.columns if c != "feature"]
    return union.groupBy("feature").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics])


def importance_report(table: DataFrame, top: int = 30) -> DataFrame:
    """Rank by total gain, top features, and features that can go (gain under 1 % of the largest, weight 0).

    One row per feature, so one window over the table is small."""
    by_gain = Window.partitionBy().orderBy(F.desc("total_gain"), "feature")
    whole = Window.partitionBy()
    ranked = table.withColumns({"rank": F.row_number().over(by_gain), "_max": F.max("gain").over(whole)})
    low = (F.col("gain") < 0.01 * F.col("_max")) & (F.col("weight") == 0)
    return ranked.withColumns({
        "is_top": (F.col("rank") <= top).cast("int"), "is_low": low.cast("int")}).drop("_max")


def top_k(df: DataFrame, by: str, k: int, *tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).limit(k)


def cv_summary(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def label_coverage(labels: DataFrame, edits: DataFrame, key: str = "changeset_id", label: str = "label") -> DataFrame:
    """How many labelled changesets have edits, in all and per label of those without."""
    seen = edits.select(key).distinct().withColumn("_seen", F.lit(1))
    rows = labels.select(key, F.col(label).cast("boolean").alias("_label")).distinct().join(seen, key, "left")
    lost = F.col("_seen").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("_seen").alias("matched"), F.count_if(lost).alias("unmatched"),
        F.count_if(lost & F.col("_label")).alias("unmatched_true"),
        F.count_if(lost & ~F.col("_label")).alias("unmatched_false"))


def box_stats(tables: dict[str, DataFrame], metrics: Sequence[str], limit: int | None = QUANTILE_ROWS) -> DataFrame:
    """Minimum, quartiles and maximum per metric and model."""
    rows = None
    for model, df in tables.items():
        entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])
        long = df.select(F.lit(model).alias("model"), F.explode(entries).alias("_e")).select("model", "_e.*")
        rows = long if rows is None else rows.unionByName(long)
    quantiles = {"low": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "high": 1.0}
    return exact_quantiles(rows, ["model", "metric"], "value", quantiles, limit)
