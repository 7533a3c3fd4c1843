"""Encoders with vocabularies that are learnt once and then frozen."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.functions import times
from editwarden.operators.rows import CHANGESET_DROPS, EDIT_DROPS, snake_columns, unnest_xzcode
from editwarden.operators.sampling import numbered
from editwarden.session import settle

CATEGORIES = ("osm_type", "contribution_type", "geometry_type", "time_of_day")
MULTI = {"countries": "country", "continents": "continent"}

def fit_vocabularies(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted different values of text columns and of lists of text, found in one pass.

    They become columns: for codes (types, countries, continents). Free text goes through ``SparseVocabulary``."""
    kinds = dict(df.dtypes)

    def entries(column):
        values = F.col(column) if kinds[column].startswith("array") else F.array(column)
        return F.transform(F.coalesce(values, F.array()), lambda v: F.struct(F.lit(column).alias("c"), v.alias("v")))

    pairs = df.select(F.explode_outer(F.concat(*[entries(c) for c in columns])).alias("_e")).select("_e.*")
    # partial aggregation leaves one row per task and value
    values = pairs.where("v IS NOT NULL").distinct()
    found = values.collect()
    return {c: sorted(row["v"] for row in found if row["c"] == c) for c in columns}


def fit_vocabulary(df: DataFrame, column: str) -> list[str]:
    return fit_vocabularies(df, [column])[column]


def multilabel(df: DataFrame, column: str, vocabulary: Sequence[str], prefix: str) -> DataFrame:
    """One 0/1 column per value of a list column."""
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != column],
        *[F.coalesce(F.array_contains(column, v), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in vocabulary])


def onehot(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """One 0/1 column per value; null and unknown values are 0 everywhere."""
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != column],
        *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in vocabulary])


@dataclass
class SparseVocabulary:
    """The values of a text column, numbered in a table, whatever their number; kept so that scoring uses the same ones."""

    column: str
    table: DataFrame  # (value, number)
    size: int

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> SparseVocabulary:
        values = df.select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL").distinct()
        table = settle(numbered(values, "value", name="number"))
        return cls(column, table, table.count())

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, column: str, path: str) -> SparseVocabulary:
        table = spark.read.parquet(path)
        return cls(column, table, table.count())

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Add the one-hot vector; its last place is for null and for values that were not there at the fit."""
        rows = df.join(self.table.select(F.col("value").alias("_v"), F.col("number").cast("double").alias("_i")), F.col(f"`{self.column}`") == F.col("_v"), "left")
        rows = rows.drop("_v").withColumn("_i", F.coalesce("_i", F.lit(float(self.size))))
        # the encoder only needs to see the largest number
        top = df.sparkSession.createDataFrame([(float(self.size),)], "_i double")
        encoder = OneHotEncoder(inputCol="_i", outputCol=out or f"{self.column}_vec", dropLast=False)
        return encoder.fit(top).transform(rows).drop("_i")


def onehot_sparse(df: DataFrame, column: str, out: str | None = None, vocabulary: SparseVocabulary | None = None) -> DataFrame:
    """One-hot vector for a vocabulary of any size: values are numbered in a table and joined."""
    return (vocabulary or SparseVocabulary.fit(df, column)).transform(df, out)


@dataclass
class EditEncoder:
    """What was learnt from the training edits."""

    multi: dict[str, list[str]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    temporal: bool = False

    @classmethod
    def fit(cls, features: DataFrame, temporal: bool = False) -> EditEncoder:
        found = fit_vocabularies(features, [c for c in (*MULTI, *CATEGORIES) if c in features.columns])
        return cls(
            multi={c: v for c, v in found.items() if c in MULTI},
            categories={c: v for c, v in found.items() if c in CATEGORIES}, temporal=temporal)

    def transform(self, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Numeric table. ``keep`` lists columns to carry along although the encoder drops them."""
        rows = _plain_history(features)
        kept = {c: f"_keep_{c}" for c in keep}
        rows = rows.withColumns({name: F.col(c) for c, name in kept.items()})
        if "xzcode" in rows.columns:
            rows = unnest_xzcode(rows)
        drops = EDIT_DROPS if self.temporal else (*EDIT_DROPS, "date_created")
        rows = snake_columns(rows.drop(*drops))
        for column, vocabulary in self.multi.items():
            rows = multilabel(rows, column, vocabulary, MULTI[column])
        for column, vocabulary in self.categories.items():
            rows = onehot(rows, column, vocabulary)
        texts = [n for n, kind in rows.dtypes if kind == "string" and not n.startswith("_keep_")]
        if texts:
            raise ValueError(f"columns that are still text: {texts}")
        return rows


def encode_edits(features: DataFrame, encoder: EditEncoder | None = None, keep: Sequence[str] = ()):
    """(encoded table, encoder); the encoder is learnt only when none is given."""
    encoder = encoder or EditEncoder.fit(features)
    return encoder.transform(features, keep), encoder


def _plain_history(df: DataFrame) -> DataFrame:
    """Previous-edit times as epoch seconds and intervals as seconds; -1 where there is none."""
    kinds = dict(df.dtypes)
    columns = {}
    for who in ("user", "element"):
        stamp, gap = f"{who}_previous_edit_timestamp", f"{who}_time_since_previous_edit"
        if stamp in kinds and kinds[stamp] == "string":
            columns[stamp] = times.text_to_epoch(F.col(stamp))
        elif stamp in kinds and kinds[stamp].startswith("timestamp"):
            columns[stamp] = F.coalesce(times.epoch_seconds(F.col(stamp)), F.lit(-1.0))
        if gap in kinds and kinds[gap] == "binary":
            columns[gap] = times.interval_seconds(F.col(gap))
    return df.withColumns(columns) if columns else df


def encode_changesets(features: DataFrame, editors: SparseVocabulary | None = None):
    """(encoded table, editors): times as epoch seconds, the editor as the one-hot vector ``created_by_vec``, text dropped."""
    rows = features.drop(*CHANGESET_DROPS)
    stamps = {c: times.epoch_seconds(F.col(c)) for c in ("closed_at", "account_created") if c in rows.columns}
    rows = rows.withColumns(stamps)
    editors = editors or SparseVocabulary.fit(rows, "created_by")
    return editors.transform(rows).drop("created_by"), editors
