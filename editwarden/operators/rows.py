"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwarden.functions import texts, times

DEFAULT_THRESHOLD = 0.5
# Columns that the encoders leave out.
EDIT_DROPS = (
    "geometry", "code", "osm_id", "members", "status", "editor_used", "source_used", "grid_cell_id", "contribution_key",
)
CHANGESET_DROPS = ("geometry", "created_at", "user", "comment", "uid", "changes_count")
FLAGGED_COLUMNS = (
    "changeset_id", "date_created", "osm_id", "osm_version", "centroid_x", "centroid_y", "y_pred", "y_prob",
)


def normalize_label(df: DataFrame, column: str) -> DataFrame:
    """0/1 label; any other value stops the job."""
    return df.withColumn(column, texts.checked_label(F.col(column)))


def restrict_to_ids(df: DataFrame, ids: DataFrame, column: str = "changeset_id") -> DataFrame:
    return df.join(ids.select(column), column, "left_semi")


def label_edits(edits: DataFrame, labels: DataFrame, changeset_id: str = "changeset.id", label: str = "vandalism") -> DataFrame:
    """Edits of the labelled changesets with their label; ``unknown`` when the label is empty."""
    labels = labels.select(F.col("changeset_id").alias("_labelled"), F.col(label).cast("string").alias("_label"))
    joined = edits.join(labels, F.col(changeset_id) == F.col("_labelled"))
    return joined.withColumn(label, F.coalesce("_label", F.lit("unknown"))).drop("_labelled", "_label")


def drop_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def unnest_xzcode(df: DataFrame, column: str = "xzcode") -> DataFrame:
    return df.withColumns({"code": F.col(f"{column}.code"), "level": F.col(f"{column}.level")}).drop(column)


def align_columns(df: DataFrame, columns: Sequence[str], fill=0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the trained columns in their order; absent ones are filled, extra ones dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns])


def flag(df: DataFrame, threshold: float | None = None, prob: str = "y_prob", out: str = "y_pred") -> DataFrame:
    limit = DEFAULT_THRESHOLD if threshold is None else float(threshold)
    return df.withColumn(out, (F.col(prob) >= F.lit(limit)).cast("int"))


def flagged(df: DataFrame) -> DataFrame:
    return df.where("y_pred = 1").select(*FLAGGED_COLUMNS)


def between_ids(df: DataFrame, low: int, high: int, column: str = "changeset_id") -> DataFrame:
    return df.where(F.col(column).between(low, high))


def between_dates(df: DataFrame, low: str, high: str, column: str = "closed_at") -> DataFrame:
    kind = df.schema[column].dataType
    return df.where(F.col(column).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def where_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def comment_contains(df: DataFrame, word: str, comment: str | Column = "comment") -> DataFrame:
    comment = F.col(comment) if isinstance(comment, str) else comment
    return df.where(comment.contains(word))


def comment_counts(df: DataFrame, word: str, comment: str | Column = "comment") -> DataFrame:
    comment = F.col(comment) if isinstance(comment, str) else comment
    return df.agg(
        F.count_if(comment.contains(word)).alias("with_word"), F.count(comment).alias("with_comment"))


def valid_points(df: DataFrame, x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """Centroids as numbers; rows without one are left out."""
    numbers = {c: F.col(c).try_cast("double") for c in (x, y)}
    return df.withColumns(numbers).dropna(subset=[x, y])


def split_ids(df: DataFrame, key: str = "changeset_id", split: str = "split") -> DataFrame:
    return df.select(key, split)


def mine_reverts(changesets: DataFrame) -> DataFrame:
    """Changesets whose comment speaks of a revert, with the changeset number they mention."""
    return changesets.where(texts.tells_of_revert(F.col("comment"))).select(
        "changeset_id", "comment",
        texts.reverted_changeset(F.col("comment")).alias("original_changeset_id"),
        F.lit("vandalism").alias("label"),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a declared schema in its order, cast to its types; absent columns are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def with_month(df: DataFrame, ts: str, name: str = "month") -> DataFrame:
    return df.withColumn(name, times.month_label(F.col(ts)))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
