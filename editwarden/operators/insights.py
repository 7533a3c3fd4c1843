"""Further analyses: rates per place, rare tags, reverts, user profiles, spikes and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwarden.functions import places
from editwarden.functions.texts import reverted_changeset, tells_of_revert
from editwarden.session import settle


def cell_rates(df: DataFrame, size: float, label: str = "vandalism", x="centroid_x", y="centroid_y") -> DataFrame:
    """Edits and share of harmful ones per grid cell."""
    cell = places.grid_cell(F.col(x), F.col(y), size).alias("cell")
    return df.groupBy(cell).agg(F.count(F.lit(1)).alias("edits"), F.avg(F.col(label).cast("double")).alias("rate"))


def rate_encode(df: DataFrame, train: DataFrame, column: str, label: str = "vandalism") -> DataFrame:
    """Rate of the training rows with the same value; the overall training rate for new values."""
    total = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rates = train.groupBy(F.col(column).alias("_value")).agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    joined = df.join(rates, F.col(column).eqNullSafe(F.col("_value")), "left")
    return joined.withColumn(f"{column}_rate", F.coalesce("_rate", F.lit(total))).drop("_value", "_rate")


def grid_cells(df: DataFrame, sizes: Sequence[float], x="centroid_x", y="centroid_y") -> DataFrame:
    return df.withColumns({
        f"cell_{str(s).replace('.', '_')}": places.grid_cell(F.col(x), F.col(y), s) for s in sizes})


def rare_tags(df: DataFrame, n: int, key: str = "ck", tags: str = "tags") -> DataFrame:
    """Number of rare tag keys (used in fewer than ``n`` edits) per edit that has one.

    Keys are counted with partial aggregation. A frequent key has no row on the other side, so its
    rows end in the join; skewed partitions are split there."""
    used = df.select(key, F.explode(F.map_keys(tags)).alias("_tag"))
    counts = settle(used.groupBy("_tag").agg(F.count(F.lit(1)).alias("_n")))
    rare = counts.where(F.col("_n") < n).select("_tag")
    found = used.join(rare, "_tag")
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("rare_tags"))


def revert_counts(changesets: DataFrame) -> DataFrame:
    """How often each changeset is named by a comment that speaks of a revert."""
    named = changesets.where(tells_of_revert(F.col("comment"))).select(
        reverted_changeset(F.col("comment")).cast("bigint").alias("changeset_id"))
    return named.where("changeset_id IS NOT NULL").groupBy("changeset_id").agg(F.count(F.lit(1)).alias("reverts"))


def neighbour_z(df: DataFrame, size: float, column: str = "area_delta", x="centroid_x", y="centroid_y") -> DataFrame:
    """How far an edit lies from the other edits of its grid cell, in standard deviations; 0 if all agree."""
    rows = df.withColumn("_cell", places.grid_cell(F.col(x), F.col(y), size))
    value = F.col(column).cast("double")
    per = rows.groupBy(F.col("_cell").alias("_c")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    z = F.when(F.col("_dev") > 0, (value - F.col("_mean")) / F.col("_dev")).otherwise(F.lit(0.0))
    return rows.join(per, F.col("_cell") == F.col("_c")).withColumn(f"{column}_z", z).drop("_cell", "_c", "_mean", "_dev")


def new_region(df: DataFrame, user="user_id", regions="country_iso_a3", ts="valid_from", key="ck") -> DataFrame:
    """1 if the edit is the user's first in one of its regions."""
    pairs = df.select(user, F.explode(regions).alias("_region"), F.struct(ts, key).alias("_place"))
    firsts = pairs.groupBy(user, "_region").agg(F.min("_place").alias("_place"))
    firsts = firsts.select(F.col(f"_place.{key}").alias("_key")).distinct()
    return df.join(firsts, F.col(key) == F.col("_key"), "left").withColumn(
        "new_region", F.col("_key").isNotNull().cast("int")).drop("_key")


def relative_length_change(delta: Column, length: Column) -> Column:
    return places.relative_change(delta, length)


def user_profile(df: DataFrame, top: int = 3, user="user_id", ts="valid_from", kind="contrib_type", tags="tags") -> DataFrame:
    """Edits, creations, changes, deletions, active weeks and the most used tag keys of each user.

    Distinct weeks and keys are reduced by partial aggregation; the ranking keeps ``top`` keys."""
    base = df.groupBy(user).agg(
        F.count(F.lit(1)).alias("edits"),
        F.count_if(F.col(kind) == "CREATION").alias("creates"),
        F.count_if(F.col(kind).isin("TAG", "GEOMETRY")).alias("modifies"),
        F.count_if(F.col(kind) == "DELETION").alias("deletes"))
    weeks = df.select(user, F.date_trunc("week", F.col(ts)).alias("_week")).distinct().groupBy(user).agg(
        F.count(F.lit(1)).alias("active_weeks"))
    keys = df.select(user, F.explode(F.map_keys(tags)).alias("_k")).groupBy(user, "_k").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("_n"), "_k"))
    best = keys.withColumn("_r", rank).where(F.col("_r") <= top).groupBy(user).agg(
        F.sort_array(F.collect_list(F.struct("_r", "_k"))).alias("_top"))
    best = best.select(user, F.array_join(F.transform("_top", lambda t: t["_k"]), ",").alias("top_tags"))
    return base.join(weeks, user, "left").join(best, user, "left").fillna({"active_weeks": 0, "top_tags": ""})


def month_spikes(monthly: DataFrame, k: float, value: str = "n") -> DataFrame:
    """Months whose figure lies more than ``k`` standard deviations from the mean of all months.

    One row per month, so one window over the table is small."""
    whole = Window.partitionBy()
    mean, dev = F.avg(value).over(whole), F.stddev_pop(value).over(whole)
    z = F.when(dev > 0, (F.col(value) - mean) / dev).otherwise(F.lit(0.0))
    return monthly.withColumn("z", z).withColumn("spike", (F.abs("z") > k).cast("int"))


def interact(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with mean 0 and deviation 1, learnt by one aggregate; constant columns become 0."""
    facts = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_samp))]).first()
    out = {}
    for c in columns:
        mean, dev = facts[f"mean_{c}"], facts[f"dev_{c}"]
        out[f"{c}_scaled"] = (F.col(c) - F.lit(mean)) / F.lit(dev) if dev else F.lit(0.0)
    return df.withColumns(out)


def changeset_outliers(df: DataFrame, by: str = "changeset_id", k: float = 1.5) -> DataFrame:
    """Changesets whose number of edits lies beyond the quartile fences.

    Quartiles come from the counts of each size, of which there are few (at most sqrt(2N))."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("times"))
    q = sizes.agg(F.expr("percentile(CAST(n AS DOUBLE), array(0.25D, 0.75D), times)").alias("q")).first()["q"]
    if q is None:
        return counts.where(F.lit(False))
    low, high = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
    return counts.where((F.col("n") < F.lit(low)) | (F.col("n") > F.lit(high)))


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mean score per bin of equal width of a feature, and the correlation of both over all rows."""
    facts = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"), F.corr(x, y).alias("corr")).first()
    v = F.col(x).cast("double")
    width = (facts["hi"] - facts["lo"]) / bins if facts["hi"] is not None else None
    number = F.least(F.floor((v - F.lit(facts["lo"])) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    return df.where(v.isNotNull()).groupBy(number.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean")).withColumn("corr", F.lit(facts["corr"]))
