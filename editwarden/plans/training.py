"""Training run and the stack of changeset models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.functions.texts import checked_label
from editwarden.operators.aggregates import score_profile
from editwarden.operators.clusters import N_CLUSTERS, assign_clusters, fit_clusters
from editwarden.operators.encoders import EditEncoder
from editwarden.operators.joins import require_ids, require_same_labels, split_like, stack_inputs
from editwarden.operators.metrics import best_threshold, compare_models, evaluate
from editwarden.operators.models import (
    PROFILE_FEATURES, cross_validate, fit_hyper, fit_meta, fit_model, importances, patient_trees, score, stored_vectors, training_curve, with_inputs,
)
from editwarden.operators.rows import flag
from editwarden.operators.sampling import geographic_split, realistic_split, temporal_split
from editwarden.plans.features import FeatureSettings, build_features, numeric_columns
from editwarden.plans.ledger import remove
from editwarden.plans.scoring import Scorer
from editwarden.session import scratch_path, settle

# Settings of the trees used when none are searched for.
BEST_PARAMETERS = {
    "subsample": 0.6, "scale_pos_weight": 4.5, "n_estimators": 100, "min_child_weight": 1, "max_depth": 9,
    "learning_rate": 0.3, "lambda": 0, "gamma": 2, "colsample_bytree": 0.6, "alpha": 2,
}
# Years and regions of the default splits.
YEARS = {"train": [2018, 2019], "val": [2015], "test": [2017]}
REGIONS = {
    "train": ["Oceania", "Europe", "South America"],
    "val": ["Africa", "Antarctica", "Other"],
    "test": ["North America", "Asia"],
}


@dataclass(frozen=True)
class TrainSettings:
    split: str = "random"  # random, temporal or geographic
    test: int = 150_000
    val: int = 50_000
    ratio: float = 0.2
    years: Mapping[str, Sequence[int]] = field(default_factory=lambda: YEARS)
    regions: Mapping[str, Sequence[str]] = field(default_factory=lambda: REGIONS)
    region_column: str = "continents"
    clusters: int = N_CLUSTERS
    params: Mapping = field(default_factory=lambda: BEST_PARAMETERS)
    patience: int = 20  # rounds without a lower validation loss after which no further round counts
    use_changeset_id: bool = False
    features: FeatureSettings = field(default_factory=FeatureSettings)


def split_features(features: DataFrame, settings: TrainSettings) -> DataFrame:
    """Add the split column before encoding, where keys, dates and regions are still there."""
    label = settings.features.label
    if settings.split == "random":
        return realistic_split(features, "contribution_key", settings.test, settings.val, settings.ratio, label)
    if settings.split == "temporal":
        return temporal_split(features, "date_created", settings.years)
    if settings.split == "geographic":
        return geographic_split(features, settings.region_column, settings.regions)
    raise ValueError(f"unknown split {settings.split}")


@dataclass
class TrainResult:
    scorer: Scorer
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame


def train_run(edits: DataFrame, settings: TrainSettings = TrainSettings()) -> TrainResult:
    """Features, split, encoding, clusters, trees, threshold and evaluation.

    The label must be 0 or 1. The encoder sees training rows only. What several steps read is written once as parquet: the features, until they
    are encoded; the encoded rows as vectors, in a folder for each split; and the scores, which threshold, metrics and predictions read."""
    label, spark = settings.features.label, edits.sparkSession
    features = build_features(edits, settings.features)
    path = scratch_path(spark, "features")
    features.withColumn(label, checked_label(F.col(label))).write.parquet(path)
    rows = split_features(spark.read.parquet(path), settings).withColumnRenamed("split", "_keep_split")
    train = rows.where(F.col("_keep_split") == "train")
    encoder = EditEncoder.fit(train)
    centers = fit_clusters(train, settings.clusters)
    encoded = assign_clusters(encoder.transform(rows, keep=["contribution_key"]), centers)
    left_out = [label] if settings.use_changeset_id else [label, "changeset_id"]
    columns = numeric_columns(encoded, exclude=left_out)
    vectors = stored_vectors(encoded, columns, label, "_keep_split", ["_keep_contribution_key", "changeset_id"])
    remove(spark, path)
    trees, _ = patient_trees(vectors, settings.params, label, "_keep_split", settings.patience, store=False)
    scores = scratch_path(spark, "predictions")
    scored = score(vectors, trees).select(
        F.col("_keep_contribution_key").alias("contribution_key"), "changeset_id",
        F.col("_keep_split").alias("split"), F.col(label).alias("y_true"), "y_prob")
    scored.write.parquet(scores)
    scored = spark.read.parquet(scores)
    threshold = best_threshold(scored.where("split = 'val'").select("y_true", "y_prob")).first()["threshold"]
    model = with_inputs(trees, columns)
    scorer = Scorer(model, columns, encoder, centers, threshold, settings.features)
    predictions = flag(scored, threshold)
    metrics = evaluate(predictions, ["split"], threshold)
    return TrainResult(scorer, predictions, metrics, importances(model, columns, edits.sparkSession))


def training_progress(result: TrainResult, encoded: DataFrame, label: str) -> DataFrame:
    return training_curve(result.scorer.model, encoded, label)


@dataclass
class StackResult:
    hyper: object
    meta: object
    scores: DataFrame
    comparison: DataFrame


def stack_run(
    edit_scores: DataFrame, labels: DataFrame, main: DataFrame, params: Mapping, kind: str = "logistic_regression",
) -> StackResult:
    """Two-level stack on changesets.

    ``edit_scores``: (changeset_id, predicted_prob) per edit; ``labels``: (changeset_id, label);
    ``main``: (changeset_id, split, y_true, y_prob_main) of the changeset model. Train and val fit
    the second model, test fits the third, and test_meta compares all three."""
    profiles = score_profile(edit_scores)
    split_ids = main.select("changeset_id", "split")
    require_ids(split_ids, profiles)
    rows = settle(split_like(profiles, labels, split_ids))
    hyper = fit_hyper(rows, params)
    hyper_scores = score(rows, hyper, "y_prob_hyper").select("changeset_id", F.col("label").cast("int").alias("y_true"), "y_prob_hyper")
    require_same_labels(main, hyper_scores)
    stacked = settle(stack_inputs(main, hyper_scores).join(split_ids, "changeset_id"))
    meta = fit_meta(stacked.where("split = 'test'"), kind, params)
    scores = score(stacked.where("split = 'test_meta'"), meta, "y_prob_meta")
    models = {}
    for name in ("main", "hyper", "meta"):
        scores = flag(scores, 0.5, f"y_prob_{name}", f"y_pred_{name}")
        models[name] = (f"y_pred_{name}", f"y_prob_{name}")
    return StackResult(hyper, meta, scores, compare_models(scores, models))


def ablate(df: DataFrame, features: Sequence[str], params: Mapping, steps: int, label: str = "label", split: str = "split") -> DataFrame:
    """Refit without the most important feature, step by step, and compare on the test rows."""
    left, out = list(features), None
    for step in range(steps + 1):
        model = fit_model(df, left, params, label, split)
        scored = flag(score(df.where(F.col(split) == "test"), model).select(F.col(label).alias("y_true"), "y_prob"))
        line = evaluate(scored, ()).withColumns({"step": F.lit(step), "features": F.lit(len(left))})
        out = line if out is None else out.unionByName(line)
        if step < steps:
            top = importances(model, left, df.sparkSession).orderBy(F.desc("total_gain"), "feature").first()["feature"]
            left.remove(top)
    return out


__all__ = [
    "PROFILE_FEATURES", "StackResult", "TrainResult", "TrainSettings", "ablate", "cross_validate", "split_features",
    "stack_run", "train_run", "training_progress",
]
