"""The whole training run, on edits and on changesets, in steps that are stored and run once.

A run has a folder. Each step stores its table, its facts or its model there under a fingerprint of its settings, of the input rows and of the steps it
reads, so a run that was stopped goes on after its last finished step, and a changed setting runs again only what depends on it.
Steps can be switched off; what needs them is then left out, too."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.functions import places
from editwarden.functions.texts import checked_label
from editwarden.operators.aggregates import score_profile
from editwarden.operators.bootstrap import bootstrap, bootstrap_summary
from editwarden.operators.clusters import assign_clusters, fit_clusters
from editwarden.operators.encoders import EditEncoder, SparseVocabulary, encode_changesets
from editwarden.operators.joins import require_ids, require_same_labels, split_like, stack_inputs
from editwarden.operators.metrics import best_threshold, compare_models, evaluate, regional_report
from editwarden.operators.models import fit_hyper, fit_meta, fit_patient, importances, load_model, save_model, score
from editwarden.operators.rows import flag
from editwarden.operators.sampling import meta_split
from editwarden.plans.features import build_features, changeset_features, numeric_columns
from editwarden.plans.ledger import StepRunner, content_key, fingerprint
from editwarden.plans.scoring import Scorer
from editwarden.plans.training import TrainSettings, split_features

STEPS = (
    "data_loading", "feature_engineering", "data_splitting", "preprocessing", "clustering", "training", "evaluation",
    "bootstrapping_evaluation", "geographical_evaluation", "hyper_classifier", "meta_classifier")


@dataclass(frozen=True)
class RunSettings:
    train: TrainSettings = field(default_factory=TrainSettings)
    iterations: int = 1000
    poisson: bool = False  # weights instead of draws in the bootstrap, for large test sets
    held_out: float = 0.4  # of the changesets
    validation: float = 0.25  # of those held out
    meta_test: float = 0.5  # of the rest
    meta_kind: str = "logistic_regression"
    hyper_params: Mapping | None = None  # the trees of the main model if None
    skip: tuple[str, ...] = ()

    def __post_init__(self):
        unknown = set(self.skip) - set(STEPS)
        if unknown:
            raise ValueError(f"unknown steps {sorted(unknown)}")


@dataclass
class RunResult:
    """Tables by name (None where a step was left out), the scorer of an edit run, and the steps that really ran."""

    tables: dict[str, DataFrame | None]
    ran: list[str]
    scorer: Scorer | None = None


def _judge(runner: StepRunner, settings: RunSettings, predictions: DataFrame | None, key: str, threshold, region: str) -> dict[str, DataFrame | None]:
    """Evaluation, bootstrap and regions of predictions (key, split, y_true, y_prob, region)."""
    flagged = None if predictions is None or threshold is None else flag(predictions, threshold["threshold"])
    test = None if flagged is None else flagged.where("split = 'test'")
    return {
        "evaluation": runner.table("evaluation", lambda: evaluate(flagged, ["split"], threshold["threshold"]), needs=["predictions", "threshold"]),
        "bootstrapping_evaluation": runner.table(
            "bootstrapping_evaluation", lambda: bootstrap_summary(bootstrap(test, key, settings.iterations, poisson=settings.poisson)),
            [settings.iterations, settings.poisson], ["predictions", "threshold"]),
        "geographical_evaluation": runner.table("geographical_evaluation", lambda: regional_report(test, region), needs=["predictions", "threshold"]),
    }


def _threshold(predictions: DataFrame) -> dict:
    """The best threshold on the validation rows; 0.5 where there are none."""
    found = best_threshold(predictions.where("split = 'val'").select("y_true", "y_prob")).first()
    return {"threshold": 0.5 if found is None or found["threshold"] is None else found["threshold"]}


def _loaded(runner: StepRunner, df: DataFrame, label: str) -> dict | None:
    """Labels are checked and counted; the rows stay where they are."""
    def count():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(checked_label(F.col(label))).alias("positives")).first()
        return {"rows": row["rows"], "positives": row["positives"]}

    return runner.facts("data_loading", count, label)


def run_edits(edits: DataFrame, folder: str, settings: RunSettings = RunSettings()) -> RunResult:
    """All steps on edits. The two stacked models belong to changesets and are left out."""
    spark, train, label = edits.sparkSession, settings.train, settings.train.features.label
    runner = StepRunner(spark, folder, content_key(edits), settings.skip)
    _loaded(runner, edits, label)
    features = runner.table("feature_engineering", lambda: build_features(edits, train.features).withColumn(label, checked_label(F.col(label))),
                            train.features, ["data_loading"])
    chosen = [train.split, train.test, train.val, train.ratio, train.years, train.regions, train.region_column]
    rows = runner.table("data_splitting", lambda: split_features(features, train), chosen, ["feature_engineering"])

    def learn():
        encoder = EditEncoder.fit(rows.where("split = 'train'"))
        return {"multi": encoder.multi, "categories": encoder.categories}

    known = runner.facts("preprocessing", learn, needs=["data_splitting"])
    encoder = None if known is None else EditEncoder(known["multi"], known["categories"])
    keep = ["contribution_key", train.region_column]
    encoded = runner.table("encoded", lambda: encoder.transform(rows.withColumnRenamed("split", "_keep_split"), keep=keep), needs=["preprocessing"])
    found = runner.facts("clustering", lambda: {"centers": fit_clusters(encoded.where("_keep_split = 'train'"), train.clusters)}, train.clusters, ["encoded"])
    centers = None if found is None else [tuple(c) for c in found["centers"]]
    clustered = None if centers is None else assign_clusters(encoded, centers)
    left_out = [label] if train.use_changeset_id else [label, "changeset_id"]
    columns = [] if clustered is None else numeric_columns(clustered, exclude=left_out)

    def make(path):
        model, losses = fit_patient(clustered, columns, train.params, label, "_keep_split", train.patience)
        losses.write.parquet(os.path.join(path, "losses"))
        save_model(model, path, spark, columns=columns)

    loaded = runner.saved("training", make, lambda path: load_model(path, spark), [train.params, train.patience, train.use_changeset_id], ["clustering"])
    model = None if loaded is None else loaded[0]
    predictions = runner.table("predictions", lambda: score(clustered, model).select(
        F.col("_keep_contribution_key").alias("contribution_key"), "changeset_id", F.col("_keep_split").alias("split"),
        F.col(label).alias("y_true"), "y_prob", F.col(f"_keep_{train.region_column}").alias("regions")), needs=["training"])
    threshold = runner.facts("threshold", lambda: _threshold(predictions), needs=["predictions"])
    tables = {"features": features, "predictions": predictions} | _judge(runner, settings, predictions, "contribution_key", threshold, "regions")
    tables["importances"] = runner.table("importances", lambda: importances(model, columns, spark), needs=["training"])
    scorer = None if threshold is None else Scorer(model, columns, encoder, centers, threshold["threshold"], train.features)
    return RunResult(tables, runner.ran, scorer)


def run_changesets(changesets: DataFrame, edit_scores: DataFrame, folder: str, settings: RunSettings = RunSettings(), label: str = "label") -> RunResult:
    """All steps on changesets: the main model, the model on the profiles of edit scores, and the one that joins both.

    ``edit_scores``: (changeset_id, predicted_prob). Main and hyper model learn from train and val, the joining model from test; test_meta
    compares all three on the same ids."""
    spark, train = changesets.sparkSession, settings.train
    runner = StepRunner(spark, folder, fingerprint(content_key(changesets), content_key(edit_scores)), settings.skip)
    _loaded(runner, changesets, label)
    regions = places.continents(*[F.col(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])
    derived = changeset_features(changesets).withColumns({label: checked_label(F.col(label)), "regions": regions})
    # no later step reads the texts of the comments: they stay in the input and are not stored once more for each changeset
    features = runner.table("feature_engineering", lambda: derived.drop("comment"), needs=["data_loading"])
    shares = [settings.held_out, settings.validation, settings.meta_test]
    ids = runner.table("data_splitting", lambda: meta_split(features.select("changeset_id", label), "changeset_id", *shares, label=label),
                       shares, ["feature_engineering"])

    def split_rows():
        return features.drop(label).join(ids, "changeset_id")

    editors = runner.saved("preprocessing", lambda path: SparseVocabulary.fit(split_rows().where("split = 'train'"), "created_by").save(path),
                           lambda path: SparseVocabulary.load(spark, "created_by", path), needs=["data_splitting"])
    encoded = runner.table("encoded", lambda: encode_changesets(split_rows(), editors)[0], needs=["preprocessing"])
    found = runner.facts("clustering", lambda: {"centers": fit_clusters(encoded.where("split = 'train'"), train.clusters)}, train.clusters, ["encoded"])
    clustered = None if found is None else assign_clusters(encoded, [tuple(c) for c in found["centers"]])
    columns = [] if clustered is None else [*numeric_columns(clustered, exclude=[label, "changeset_id"]), "created_by_vec"]

    def make(path):
        model, losses = fit_patient(clustered, columns, train.params, label, "split", train.patience)
        losses.write.parquet(os.path.join(path, "losses"))
        save_model(model, path, spark, columns=columns)

    loaded = runner.saved("training", make, lambda path: load_model(path, spark), [train.params, train.patience], ["clustering"])
    predictions = runner.table("predictions", lambda: score(clustered, loaded[0]).select(
        "changeset_id", "split", F.col(label).cast("int").alias("y_true"), "y_prob", "regions"), needs=["training"])
    threshold = runner.facts("threshold", lambda: _threshold(predictions), needs=["predictions"])
    whole = None if features is None else derived  # the features with the comments, read from the input when they are asked for
    tables = {"features": whole, "splits": ids, "predictions": predictions} | _judge(runner, settings, predictions, "changeset_id", threshold, "regions")
    return RunResult(tables | _stack(runner, settings, edit_scores, ids, predictions, label), runner.ran)


def _stack(runner: StepRunner, settings: RunSettings, edit_scores: DataFrame, ids: DataFrame | None, predictions: DataFrame | None, label: str):
    spark = edit_scores.sparkSession
    params = settings.train.params if settings.hyper_params is None else settings.hyper_params

    def profiled():
        found, routes = score_profile(edit_scores), ids.select("changeset_id", "split")
        require_ids(routes, found)
        return split_like(found, ids.select("changeset_id", label), routes)

    profiles = runner.table("profiles", profiled, needs=["data_splitting"])
    hyper = runner.saved("hyper_classifier", lambda path: fit_hyper(profiles, params, label).write().save(path),
                         PipelineModel.load, params, ["profiles"])
    hyper_scores = runner.table("hyper_scores", lambda: score(profiles, hyper, "y_prob_hyper").select(
        "changeset_id", "split", F.col(label).cast("int").alias("y_true"), "y_prob_hyper"), needs=["hyper_classifier"])

    def stacked():
        main = predictions.select("changeset_id", "y_true", F.col("y_prob").alias("y_prob_main"))
        require_same_labels(main, hyper_scores)
        return stack_inputs(main, hyper_scores).join(ids.select("changeset_id", "split"), "changeset_id")

    both = runner.table("stacked", stacked, needs=["predictions", "hyper_scores"])
    meta = runner.saved("meta_classifier", lambda path: fit_meta(both.where("split = 'test'"), settings.meta_kind, params).write().save(path),
                        PipelineModel.load, [settings.meta_kind, params], ["stacked"])

    def compared():
        scores = score(both.where("split = 'test_meta'"), meta, "y_prob_meta")
        for name in ("main", "hyper", "meta"):
            scores = flag(scores, 0.5, f"y_prob_{name}", f"y_pred_{name}")
        return scores

    scores = runner.table("meta_scores", compared, needs=["meta_classifier"])
    names = {n: (f"y_pred_{n}", f"y_prob_{n}") for n in ("main", "hyper", "meta")}
    comparison = runner.table("comparison", lambda: compare_models(scores, names), needs=["meta_scores"])
    return {"hyper_scores": hyper_scores, "stacked": both, "meta_scores": scores, "comparison": comparison}
