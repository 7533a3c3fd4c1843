"""Samples and splits of exact size without sorting the table.

Rows are ordered by the md5 text of seed and key, then by key, so a choice does not depend on
partitioning. To find the row at a given rank of a stratum only a histogram over the first
digits of the hash is needed, and then the ranks inside the one bucket that holds the rank.
The cut is a (hash, key) pair; deciding on which side a row lies is a comparison in a map
step. The table itself is neither shuffled nor sorted. Keys have to be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwarden.functions.hashing import hash_bucket, seeded_hash
from editwarden.session import settle

SEED = 42
# Hash digits of a histogram bucket: 16^4 buckets per stratum, so a bucket holds 1/65536 of it.
BUCKET_DIGITS = 4
BROADCAST_STRATA = 100_000


def _hashed(df: DataFrame, stratum: str, key: str, seed) -> DataFrame:
    h = seeded_hash(F.col(key), seed)
    return df.select(
        F.col(stratum).alias("_stratum"), F.struct(h.alias("h"), F.col(key).alias("k")).alias("_place"),
        F.substring(h, 1, BUCKET_DIGITS).alias("_bucket"))


def rank_cuts(
    df: DataFrame, stratum: str, key: str, ranks: Callable[[DataFrame], DataFrame], names: Sequence[str], seed=SEED,
) -> DataFrame:
    """One row per stratum with the (hash, key) of the last row up to each wanted rank.

    ``ranks`` receives (stratum, n) and returns (stratum, one column per name). A rank below 1
    gives null (no row), one above n the last row."""
    rows = _hashed(df, stratum, key, seed)
    histogram = rows.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = settle(histogram)
    totals = histogram.groupBy(F.col("_stratum").alias(stratum)).agg(F.sum("_n").alias("n"))
    wanted = ranks(totals).join(totals.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")))
    wanted = wanted.select(
        F.col(stratum).alias("_wanted_stratum"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("cut"), F.least(F.col(name), F.col("n")).cast("bigint").alias("rank"))
            for name in names
        ])).alias("_w"),
    ).select("_wanted_stratum", "_w.*")
    # a stratum has at most 16^4 buckets
    up_to = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0)))
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))
    found = histogram.join(wanted, F.col("_stratum").eqNullSafe(F.col("_wanted_stratum")) & inside).select(
        F.col("_stratum").alias("_cut_stratum"), F.col("_bucket").alias("_cut_bucket"), "cut",
        (F.col("rank") - F.col("_before")).alias("_nth"))
    found = _small(found)
    same = F.col("_stratum").eqNullSafe(F.col("_cut_stratum")) & (F.col("_bucket") == F.col("_cut_bucket"))
    nth = F.row_number().over(Window.partitionBy("_stratum", "_bucket", "cut").orderBy("_place"))
    edge = rows.join(found, same).withColumn("_at", nth).where("_at = _nth")
    return edge.groupBy(F.col("_stratum").alias("_cut_of")).agg(
        *[F.max(F.when(F.col("cut") == name, F.col("_place"))).alias(f"_cut_{name}") for name in names])


def _small(df: DataFrame) -> DataFrame:
    """Settle a small table and broadcast it only if it is known to be small."""
    df = settle(df)
    return F.broadcast(df) if df.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else df


def within_cuts(
    df: DataFrame, stratum: str, key: str, ranks: Callable[[DataFrame], DataFrame], names: Sequence[str], seed=SEED,
) -> DataFrame:
    """Add a boolean column per name: whether the row's rank in its stratum is within the cut."""
    cuts = _small(rank_cuts(df, stratum, key, ranks, names, seed))
    place = F.struct(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    joined = df.join(cuts, F.col(stratum).eqNullSafe(F.col("_cut_of")), "left")
    inside = {name: F.coalesce(place <= F.col(f"_cut_{name}"), F.lit(False)) for name in names}
    return joined.withColumns(inside).drop("_cut_of", *[f"_cut_{n}" for n in names])


def balance(df: DataFrame, key: str, label: str = "vandalism", seed=SEED) -> DataFrame:
    """Undersample the larger class to the size of the smaller one."""
    def ranks(totals):
        # one row per class
        return totals.select(label, F.min("n").over(Window.partitionBy()).alias("_keep"))

    return within_cuts(df, label, key, ranks, ["_keep"], seed).where("_keep").drop("_keep")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, skip: int = 0, seed=SEED):
    """(sample, rest): per group the ``n`` rows after the first ``skip`` in hash order.

    Groups without more than ``n`` rows give all their rows. The sample gets ``vandalism`` 0."""
    def ranks(totals):
        large = F.col("n") > n
        return totals.select(
            group, F.when(large, skip).otherwise(0).alias("_skip"), F.when(large, skip + n).otherwise(F.col("n")).alias("_end"))

    rows = within_cuts(df, group, key, ranks, ["_skip", "_end"], seed)
    taken = F.col("_end") & ~F.col("_skip")
    sample = rows.where(taken).drop("_skip", "_end").withColumn("vandalism", F.lit(0))
    return sample, rows.where(~taken).drop("_skip", "_end")


def realistic_split(df: DataFrame, key: str, test: int, val: int, ratio: float, label: str = "label", seed=SEED) -> DataFrame:
    """Validation and test sets of given sizes with a given share of positives; the rest trains."""
    def ranks(totals):
        positive = F.col(label) == 1
        pos_val, pos_test = int(val * ratio), int(test * ratio)
        return totals.select(
            label,
            F.when(positive, pos_val).otherwise(val - pos_val).alias("_val"),
            F.when(positive, pos_val + pos_test).otherwise(val - pos_val + test - pos_test).alias("_test"))

    return _named_split(df, label, key, ranks, ["_val", "_test"], seed)


def stratified_split(df: DataFrame, key: str, test: float, val: float, label: str = "label", seed=SEED) -> DataFrame:
    """Hold out a share ``test`` of each class, of which a share ``val`` validates and the rest tests."""
    return meta_split(df, key, test, val, 0.0, label, seed)


def meta_split(
    df: DataFrame, key: str, test: float, val: float, meta: float, label: str = "label", seed=SEED,
) -> DataFrame:
    """As ``stratified_split``, with a share ``meta`` of the held-out rows that are not validation
    set aside as ``test_meta``. The four sets never overlap."""
    def ranks(totals):
        held = F.round(F.col("n") * test)
        validation = F.round(held * val)
        extra = F.round((held - validation) * meta)
        return totals.select(
            label, validation.alias("_val"), (validation + extra).alias("_test_meta"), held.alias("_test"))

    return _named_split(df, label, key, ranks, ["_val", "_test_meta", "_test"], seed)


def _named_split(df, stratum, key, ranks, names, seed) -> DataFrame:
    rows = within_cuts(df, stratum, key, ranks, names, seed)
    split = F.lit("train")
    for name in reversed(names):
        split = F.when(F.col(name), F.lit(name[1:])).otherwise(split)
    return rows.withColumn("split", split).drop(*names)


def assign_folds(df: DataFrame, key: str, k: int = 5, label: str = "label", seed=SEED) -> DataFrame:
    """Stratified folds: each class is cut into ``k`` runs whose sizes differ by one row at most."""
    names = [f"_fold_{i}" for i in range(k - 1)]

    def ranks(totals):
        return totals.select(label, *[F.floor(F.col("n") * (i + 1) / k).alias(n) for i, n in enumerate(names)])

    rows = within_cuts(df, label, key, ranks, names, seed)
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        fold = F.when(F.col(names[i]), F.lit(i)).otherwise(fold)
    return rows.withColumn("fold", fold).drop(*names)


def temporal_split(df: DataFrame, ts: str, years: Mapping[str, Sequence[int]]) -> DataFrame:
    """Splits by lists of years; rows without a date and rows of other years are left out."""
    when = F.col(ts) if dict(df.dtypes)[ts].startswith(("timestamp", "date")) else F.col(ts).try_cast("timestamp_ntz")
    split = F.lit(None).cast("string")
    for name, chosen in years.items():
        split = F.when(F.year(when).isin(*chosen), name).otherwise(split)
    return df.withColumn("split", split).where("split IS NOT NULL")


def geographic_split(df: DataFrame, regions_of: str, groups: Mapping[str, Sequence[str]], exclusive: bool = False) -> DataFrame:
    """Splits by regions. A row in regions of several splits goes to each of them, or with
    ``exclusive`` to the first one only. A split none of whose regions occurs is an error."""
    hits = F.array_compact(F.array(*[
        F.when(F.arrays_overlap(F.col(regions_of), F.array(*[F.lit(r) for r in names])), F.lit(split))
        for split, names in groups.items()
    ]))
    if exclusive:
        return df.withColumn("split", F.get(hits, F.lit(0))).where("split IS NOT NULL")
    return df.withColumn("split", F.explode_outer(hits)).where("split IS NOT NULL")


def check_regions(df: DataFrame, regions_of: str, groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Regions of each split that occur in no row; an error if a split has none that occurs."""
    asked = sorted({r for names in groups.values() for r in names})
    # one row with one flag per asked region
    seen = df.agg(*[F.max(F.array_contains(regions_of, r)).alias(f"_{i}") for i, r in enumerate(asked)]).first()
    known = {r for i, r in enumerate(asked) if seen[i]}
    for split, names in groups.items():
        if not known & set(names):
            raise ValueError(f"no valid regions found for {split} in {list(names)}")
    return {split: [r for r in names if r not in known] for split, names in groups.items()}


def group_split(df: DataFrame, group: str, shares: Mapping[str, float], seed=SEED) -> DataFrame:
    """All rows of a group in one split, chosen by the hash of the group; no shuffle."""
    number = hash_bucket(F.col(group), 1_000_000, seed)
    split, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        limit = F.lit(round(edge * 1_000_000))
        split = F.when(number < limit, name) if split is None else split.when(number < limit, name)
    return df.withColumn("split", split.otherwise(name))


def group_folds(df: DataFrame, group: str, k: int = 5, seed=SEED) -> DataFrame:
    """Fold number by the hash of the group, so that a place or a changeset is in one fold only."""
    return df.withColumn("fold", hash_bucket(F.col(group), k, seed))


def hash_place(key: Column, seed=SEED) -> tuple[Column, Column]:
    """(number of the hash bucket, the hash in 16 bytes); both are ordered like the text of the hash, and null for a key that is null."""
    h = seeded_hash(key, seed)
    return F.conv(F.substring(h, 1, BUCKET_DIGITS), 16, 10).cast("int"), F.unhex(h)


def bucket_sizes(df: DataFrame, key: str, seed=SEED) -> tuple[int, list[int]]:
    """(number of rows without a key, rows in each of the 16^4 buckets of the hash)."""
    sizes = [0] * 16 ** BUCKET_DIGITS
    found = df.select(hash_place(F.col(key), seed)[0].alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    for row in found:
        if row["b"] is not None:
            sizes[row["b"]] = row["n"]
    return sum(r["n"] for r in found if r["b"] is None), sizes


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, key: str, seed=SEED) -> DataFrame:
    """Reproducible random order: a range-partitioned sort by hash."""
    return df.orderBy(seeded_hash(F.col(key), seed), key)


def numbered(df: DataFrame, key: str, seed=SEED, name: str = "row") -> DataFrame:
    """Row numbers from 0 in hash order, without a single-task sort.

    The first hash digits make the bucket: its offset comes from a histogram of at most 16^4
    rows, the place in it from a window over that bucket alone."""
    h = seeded_hash(F.col(key), seed)
    rows = df.withColumns({"_h": h, "_bucket": F.substring(h, 1, BUCKET_DIGITS)})
    sizes = rows.groupBy(F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    rows = rows.withColumn("_place", place).join(F.broadcast(sizes), F.col("_bucket") == F.col("_b"))
    return rows.withColumn(name, F.col("_offset") + F.col("_place") - 1).drop("_h", "_bucket", "_b", "_offset", "_place")
