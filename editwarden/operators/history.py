"""What a user and a map element did before an edit.

Every operator orders edits by time and then by the unique edit key. Hot users and elements
are handled by ``running``; counts per key are partial aggregates joined back, so that the
skew-join handling of adaptive execution can split a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.functions.times import DAY_SECONDS, epoch_micros
from editwarden.operators.running import HOT_ROWS, running

USER, ELEMENT, TIME, KEY, CHANGESET = "user_id", "osm_id", "valid_from", "ck", "changeset_id"


def _seconds_since(previous: str, ts: str):
    gap = (epoch_micros(F.col(ts)) - epoch_micros(F.col(previous))) / F.lit(1e6)
    return F.coalesce(gap, F.lit(-1.0))


def user_total(df: DataFrame, user: str = USER, name: str = "n_edits") -> DataFrame:
    """Number of all edits of the user."""
    sizes = df.groupBy(F.col(user).alias("_user")).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, F.col(user).eqNullSafe(F.col("_user"))).drop("_user")


def user_edits_cum(df: DataFrame, user=USER, ts=TIME, key=KEY, limit=HOT_ROWS) -> DataFrame:
    return running(df, [user], [ts, key], sums={"user_n_edits_cum": F.lit(1)}, limit=limit)


def user_distinct_cum(df: DataFrame, user=USER, ts=TIME, key=KEY, changeset=CHANGESET, limit=HOT_ROWS) -> DataFrame:
    """Number of different changesets and of different days of the user so far."""
    rows = df.withColumn("_day", F.col(ts).cast("date"))
    return running(
        rows, [user], [ts, key],
        distinct={"user_n_changesets_cum": changeset}, steps={"user_n_edit_days_cum": "_day"}, limit=limit,
    ).drop("_day")


def user_recency(df: DataFrame, user=USER, ts=TIME, key=KEY, limit=HOT_ROWS) -> DataFrame:
    """Time of the user's edit before, and seconds since then (-1 for the first)."""
    rows = running(df, [user], [ts, key], previous={"user_previous_edit_timestamp": ts}, limit=limit)
    return rows.withColumn("user_time_since_previous_edit", _seconds_since("user_previous_edit_timestamp", ts))


def user_history(df: DataFrame, user=USER, ts=TIME, key=KEY, changeset=CHANGESET, limit=HOT_ROWS) -> DataFrame:
    """All six user columns with one shuffle by user."""
    rows = running(
        df.withColumn("_day", F.col(ts).cast("date")), [user], [ts, key],
        sums={"user_n_edits_cum": F.lit(1)},
        distinct={"user_n_changesets_cum": changeset}, steps={"user_n_edit_days_cum": "_day"},
        totals={"n_edits": F.lit(1)}, previous={"user_previous_edit_timestamp": ts}, limit=limit,
    ).drop("_day")
    return rows.withColumn("user_time_since_previous_edit", _seconds_since("user_previous_edit_timestamp", ts))


def element_cum(df: DataFrame, element=ELEMENT, user=USER, ts=TIME, key=KEY, limit=HOT_ROWS) -> DataFrame:
    """Versions of the element so far and different users so far."""
    return running(
        df, [element], [ts, key],
        sums={"element_n_versions": F.lit(1)}, distinct={"element_n_users_cum": user}, limit=limit)


def element_recency(df: DataFrame, element=ELEMENT, ts=TIME, key=KEY, limit=HOT_ROWS) -> DataFrame:
    rows = running(df, [element], [ts, key], previous={"element_previous_edit_timestamp": ts}, limit=limit)
    return rows.withColumn("element_time_since_previous_edit", _seconds_since("element_previous_edit_timestamp", ts))


def element_history(df: DataFrame, element=ELEMENT, user=USER, ts=TIME, key=KEY, limit=HOT_ROWS) -> DataFrame:
    """All four element columns with one shuffle by element."""
    rows = running(
        df, [element], [ts, key], sums={"element_n_versions": F.lit(1)},
        distinct={"element_n_users_cum": user}, previous={"element_previous_edit_timestamp": ts}, limit=limit)
    return rows.withColumn("element_time_since_previous_edit", _seconds_since("element_previous_edit_timestamp", ts))


def rows_within(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str, limit: int = HOT_ROWS) -> DataFrame:
    """Number of rows of the same key in the ``seconds`` before a row, rows at its own time included.

    Each (key, time) enters with its number of rows and leaves after ``seconds``; the running sum
    at an entry is the answer. The work is linear, whatever the number of rows in the window."""
    micros = epoch_micros(F.col(ts))
    per_time = df.groupBy(*keys, micros.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    moves = F.array(
        F.struct(F.col("_at").alias("_when"), F.lit(1).alias("_enters"), F.col("_n").alias("_count")),
        F.struct((F.col("_at") + F.lit(seconds * 1_000_000 + 1)).alias("_when"), F.lit(0).alias("_enters"), (-F.col("_n")).alias("_count")),
    )
    events = per_time.select(*keys, F.explode(moves).alias("_e")).select(*keys, "_e.*")
    counts = running(events, keys, ["_when", "_enters"], sums={name: F.col("_count")}, limit=limit)
    counts = counts.where("_enters = 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_when", name)
    same = micros == F.col("_when")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(counts, same, "left").drop("_when", *[f"_k_{k}" for k in keys])


def user_rate(df: DataFrame, days: int, user=USER, ts=TIME, limit=HOT_ROWS) -> DataFrame:
    """Edits of the user in the last ``days`` days."""
    return rows_within(df, [user], ts, days * DAY_SECONDS, f"user_edits_{days}d", limit)


def element_churn(df: DataFrame, hours: int, element=ELEMENT, ts=TIME, limit=HOT_ROWS) -> DataFrame:
    """Changes of the element in the last ``hours`` hours."""
    return rows_within(df, [element], ts, hours * 3600, f"element_edits_{hours}h", limit)


def user_mean_size(df: DataFrame, user=USER, ts=TIME, key=KEY, limit=HOT_ROWS) -> DataFrame:
    """Mean area and length change over the user's earlier edits; null for the first edit."""
    rows = running(df, [user], [ts, key], limit=limit, sums={
        "_n": F.lit(1), "_area": F.col("area_delta"), "_length": F.col("length_delta")})
    earlier = F.col("_n") - 1
    return rows.withColumns({
        "user_mean_area_delta": F.try_divide((F.col("_area") - F.col("area_delta")).cast("double"), earlier),
        "user_mean_length_delta": F.try_divide((F.col("_length") - F.col("length_delta")).cast("double"), earlier),
    }).drop("_n", "_area", "_length")


def edit_duration(df: DataFrame, element=ELEMENT, ts=TIME, until="valid_to", key=KEY, limit=HOT_ROWS) -> DataFrame:
    """Seconds an edit was valid; the next version of the element ends it when no end is stored."""
    rows = running(df, [element], [ts, key], following={"_next": ts}, limit=limit)
    end = F.coalesce(F.col(until), F.col("_next"))
    gap = (epoch_micros(end) - epoch_micros(F.col(ts))) / F.lit(1e6)
    return rows.withColumn("edit_duration", gap).drop("_next")
