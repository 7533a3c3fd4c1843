"""Running sums, distinct counts and neighbours along an order, safe for hot keys.

A window partition is one task. That is fine for a user with thousands of edits, not for one
with a third of the table. Groups up to ``HOT_ROWS`` rows take an ordinary window; the rows of
larger groups are placed by range over (key, order), so that one group spreads over many
chunks. Each chunk is summed alone, and what the earlier chunks of the same key held is added
from a table with one row per (chunk, key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwarden.session import settle

# Largest group that one window task may hold.
HOT_ROWS = 2_000_000
# Most hot keys that are broadcast; with more of them the split is an ordinary join.
BROADCAST_KEYS = 100_000
# Rows aimed at per chunk of a hot key, and the most chunks.
CHUNK_ROWS = 1_000_000
MAX_CHUNKS = 20_000


def split_hot(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS):
    """Return (rows of ordinary groups, rows of groups above ``limit``); None stands for no rows.

    The count runs on the key columns alone. At most rows / limit keys can be hot."""
    if not keys:
        return (df, None) if df.count() <= limit else (None, df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.where(F.col("_rows") > limit).select(F.struct(*keys).alias("_hot"))
    found = hot.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return df, None
    if len(found) <= BROADCAST_KEYS:
        hot = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    # struct equality also matches keys that are null
    same = F.struct(*[df[k] for k in keys]) == hot["_hot"]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    distinct: Mapping[str, str] | None = None,
    steps: Mapping[str, str] | None = None,
    totals: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    limit: int | None = HOT_ROWS,
) -> DataFrame:
    """Add columns computed along ``order`` (unique within ``keys``).

    sums       running sum, the current row included
    distinct   number of different values of a column so far
    steps      the same for a column that never falls along the order (saves a sort)
    totals     sum over the whole group
    previous   value of a column in the row before; ``following`` in the row after
    ``limit=None`` says that no group is large and saves the check.
    """
    wanted = dict(
        sums=dict(sums or {}), distinct=dict(distinct or {}), steps=dict(steps or {}),
        totals=dict(totals or {}), previous=dict(previous or {}), following=dict(following or {}),
    )
    cold, hot = (df, None) if limit is None else split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        parts.append(_by_window(cold, list(keys), list(order), **wanted))
    if hot is not None:
        parts.append(_by_chunk(hot, list(keys), list(order), **wanted))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_window(df, keys, order, *, sums, distinct, steps, totals, previous, following):
    # one shuffle by key serves every window below
    rows = df.repartition(*keys) if keys else df
    flags = {}
    for name, value in distinct.items():
        flags[name] = f"_new_{name}"
        first = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) == 1
        rows = rows.withColumn(flags[name], first.cast("bigint"))
    along = Window.partitionBy(*keys).orderBy(*order)
    for name, value in steps.items():
        # the flags inside the struct keep this window above theirs, so that it shares the last sort
        before = F.lag(F.struct(F.col(value).alias("_value"), *flags.values())).over(along)
        flags[name] = f"_new_{name}"
        changed = before.isNull() | ~F.col(value).eqNullSafe(before["_value"])
        rows = rows.withColumn(flags[name], changed.cast("bigint"))
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    added = {name: F.sum(value).over(so_far) for name, value in sums.items()}
    added |= {name: F.sum(flag).over(so_far) for name, flag in flags.items()}
    added |= {name: F.sum(value).over(whole) for name, value in totals.items()}
    added |= {name: F.lag(value).over(along) for name, value in previous.items()}
    added |= {name: F.lead(value).over(along) for name, value in following.items()}
    return rows.withColumns(added).drop(*flags.values())


def _by_chunk(df, keys, order, *, sums, distinct, steps, totals, previous, following):
    sums = dict(sums)
    rows = df
    flags = []
    for name, value in (distinct | steps).items():
        # the first row of a value, found by a partial aggregate and marked through its place
        firsts = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_place"))
        firsts = firsts.select(F.struct(*keys, "_place").alias(f"_first_{name}"))
        place = F.struct(*keys, F.struct(*order).alias("_place"))
        rows = rows.join(firsts, place == F.col(f"_first_{name}"), "left")
        rows = rows.withColumn(f"_new_{name}", F.col(f"_first_{name}").isNotNull().cast("bigint"))
        rows = rows.drop(f"_first_{name}")
        flags.append(f"_new_{name}")
        sums[name] = F.col(f"_new_{name}")
    chunks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    chunks = max(chunks, min(-(-df.count() // CHUNK_ROWS), MAX_CHUNKS))
    rows = rows.repartitionByRange(chunks, *keys, *order)
    rows = rows.withColumn("_chunk", F.spark_partition_id()).withColumn("_key", F.struct(F.lit(0), *keys))
    # the placement comes from sampled bounds, so it is frozen before it is used twice
    rows = settle(rows)

    place = F.struct(*order)
    edges = rows.groupBy("_key", "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()],
        *[F.sum(v).alias(f"_all_{n}") for n, v in totals.items()],
        *[F.max_by(v, place).alias(f"_last_{n}") for n, v in previous.items()],
        *[F.min_by(v, place).alias(f"_head_{n}") for n, v in following.items()],
    )
    # at most one row per chunk and key
    by_key = Window.partitionBy("_key").orderBy("_chunk")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    edges = edges.select(
        F.col("_key").alias("_edge_key"), F.col("_chunk").alias("_edge_chunk"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in sums],
        *[F.sum(f"_all_{n}").over(whole).alias(n) for n in totals],
        *[F.lag(f"_last_{n}").over(by_key).alias(f"_last_{n}") for n in previous],
        *[F.lead(f"_head_{n}").over(by_key).alias(f"_head_{n}") for n in following],
    )
    along = Window.partitionBy("_key", "_chunk").orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {f"_in_{n}": F.sum(v).over(so_far) for n, v in sums.items()}
    inside |= {f"_in_{n}": F.lag(v).over(along) for n, v in previous.items()}
    inside |= {f"_in_{n}": F.lead(v).over(along) for n, v in following.items()}
    inside |= {"_at": F.row_number().over(along), "_size": F.count(F.lit(1)).over(Window.partitionBy("_key", "_chunk"))}
    rows = rows.withColumns(inside)
    same = (F.col("_key") == F.col("_edge_key")) & (F.col("_chunk") == F.col("_edge_chunk"))
    rows = rows.join(edges, same)
    added = {n: F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.col(f"_sum_{n}") for n in sums}
    added |= {n: F.when(F.col("_at") == 1, F.col(f"_last_{n}")).otherwise(F.col(f"_in_{n}")) for n in previous}
    added |= {
        n: F.when(F.col("_at") == F.col("_size"), F.col(f"_head_{n}")).otherwise(F.col(f"_in_{n}"))
        for n in following
    }
    names = list(df.columns)
    return rows.withColumns(added).select(*names, *_added_names(distinct, steps, sums, totals, previous, following))


def _added_names(distinct, steps, sums, totals, previous, following):
    plain = [n for n in sums if n not in distinct and n not in steps]
    return [*plain, *distinct, *steps, *totals, *previous, *following]
