"""Boosted trees: patience, curves, saved prefixes."""

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from editwarden.operators.metrics import areas
from editwarden.operators.models import cut_rounds, fit_model, fit_patient, patient_round, score, training_curve

FEATURES = ["x.y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1500).select("id", (F.col("id") % 10).cast("double").alias("x.y"), F.floor(F.rand(3) * 20).cast("double").alias("z"))
    return df.withColumn("label", (F.col("`x.y`") + 3 * F.rand(9) >= 6).cast("int")).withColumn(
        "split", F.when(F.col("id") % 3 == 0, "val").when(F.col("id") % 3 == 1, "train").otherwise("test"))


def plain_curve(model, df):
    """Log loss after each round, row by row."""
    trees = model.stages[-1]
    inputs = PipelineModel(model.stages[:-1]).transform(df).collect()
    out, margins = [], [0.0] * len(inputs)
    for tree, weight in zip(trees.trees, trees.treeWeights):
        margins = [m + weight * tree.predict(r["_features"]) for m, r in zip(margins, inputs)]
        p = [1 / (1 + math.exp(-2 * m)) for m in margins]
        out.append(sum(-math.log(q if r["label"] else 1 - q) for q, r in zip(p, inputs)) / len(p))
    return out, p


def test_patience_keeps_the_first_best_round():
    assert patient_round([5, 4, 3, 4, 5, 6, 1], 3) == 2
    assert patient_round([5, 4, 3, 4, 5, 6, 1], 4) == 6
    assert patient_round([5, 5, 5], 20) == 0 and patient_round([1.0], 1) == 0
    assert patient_round([3, 2, 2, 1], 2) == 3


def test_model_is_cut_to_its_best_round(spark, rows, tmp_path):
    params = {"n_estimators": 8, "max_depth": 5, "learning_rate": 0.9}
    model, losses = fit_patient(rows, FEATURES, params, patience=3)
    found = [r.logloss for r in losses.orderBy("round").collect()]
    best = patient_round(found, 3)
    trees = model.stages[-1]
    assert len(found) == 8 and trees.getNumTrees == best + 1 < 8 and trees.treeWeights[0] == 1.0
    val = rows.where("split = 'val'")
    curve, p = plain_curve(model, val)
    assert curve == pytest.approx(found[:best + 1], abs=1e-9)
    assert sorted(r.y_prob for r in score(val, model).collect()) == pytest.approx(sorted(p), abs=1e-9)
    # the cut model is a model like any other: saved, loaded, cut again
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert sorted(r.y_prob for r in score(val, loaded).collect()) == pytest.approx(sorted(p), abs=1e-12)
    assert cut_rounds(loaded, 1).stages[-1].getNumTrees == 1


def test_without_validation_rows_all_rounds_stay(rows):
    model, losses = fit_patient(rows.where("split <> 'val'"), FEATURES, {"n_estimators": 3, "max_depth": 2})
    assert model.stages[-1].getNumTrees == 3 and losses.count() == 0


def test_curve_from_signatures(rows):
    model = fit_model(rows, FEATURES, {"n_estimators": 4, "max_depth": 3}, split=None)
    val = rows.where("split = 'val'")
    got = training_curve(model, val).orderBy("round").collect()
    curve, _ = plain_curve(model, val)
    assert [r.logloss for r in got] == pytest.approx(curve, abs=1e-9)
    whole = areas(score(val, model).select(F.col("label").alias("y_true"), "y_prob")).first()
    assert got[-1].auc == pytest.approx(whole.auc_roc, abs=1e-12)
    wrong = score(val, model).where((F.col("y_prob") >= 0.5).cast("int") != F.col("label")).count() / val.count()
    assert got[-1].error == pytest.approx(wrong) and got[-1].accuracy == pytest.approx(1 - wrong)
