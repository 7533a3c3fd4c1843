"""The whole run on edits and changesets: steps once, stopped and resumed, switched off."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from checks.learning import SETTINGS, TREES, changeset_run, full_edits
from editwarden.plans import runs
from editwarden.plans.runs import STEPS, RunSettings, run_edits
from editwarden.plans.scoring import score_edits
from editwarden.plans.training import TrainSettings

SF = "/root/testdata/sf0.001"
STACK = {"profiles", "hyper_classifier", "hyper_scores", "stacked", "meta_classifier", "meta_scores", "comparison"}


def labelled(spark):
    large = (F.col("l_quantity") > 25).cast("int")
    return full_edits(spark, SF).withColumn("vandalism", F.when(F.col("h") % 20 == 0, 1 - large).otherwise(large))


def test_changeset_run_is_resumed_where_it_stopped(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    with monkeypatch.context() as patch:
        patch.setattr(runs, "fit_meta", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            changeset_run(spark, SF, folder)
    done = changeset_run(spark, SF, folder)
    assert done.ran == ["meta_classifier", "meta_scores", "comparison"]
    assert changeset_run(spark, SF, folder).ran == []
    t = done.tables
    ids = {r.split: {x for x in r.ids} for r in t["splits"].groupBy("split").agg(F.collect_list("changeset_id").alias("ids")).collect()}
    assert set(ids) == {"train", "val", "test", "test_meta"} and sum(map(len, ids.values())) == t["features"].count()
    for name in ("meta_scores",):
        assert {r.changeset_id for r in t[name].collect()} == ids["test_meta"]
    assert {r.changeset_id for r in t["hyper_scores"].where("split = 'test'").collect()} == ids["test"]
    compared = {r.model: r for r in t["comparison"].collect()}
    assert set(compared) == {"main", "hyper", "meta"}
    assert all(r.TP + r.TN + r.FP + r.FN == len(ids["test_meta"]) for r in compared.values())
    # the profile of the edit scores tells the label, the main model cannot know it as well
    assert compared["hyper"].auc_roc > 0.8 and compared["meta"].auc_roc > 0.8
    assert t["bootstrapping_evaluation"].count() == 6 and t["geographical_evaluation"].count() > 0
    # another setting of one step runs that step and what depends on it
    other = changeset_run(spark, SF, folder, meta_kind="trees")
    assert other.ran == ["meta_classifier", "meta_scores", "comparison"]
    without = changeset_run(spark, SF, folder, skip=("hyper_classifier",))
    assert without.ran == [] and without.tables["meta_scores"] is None and without.tables["evaluation"] is not None


def test_edit_run(spark, tmp_path):
    edits = labelled(spark)
    n = edits.count()
    train = TrainSettings(test=n // 4, val=n // 10, ratio=0.2, clusters=5, params=TREES, features=SETTINGS)
    settings = RunSettings(train=train, iterations=5)
    first = run_edits(edits, str(tmp_path), settings)
    assert set(first.ran) >= set(STEPS) - {"hyper_classifier", "meta_classifier"} and not set(first.ran) & STACK
    again = run_edits(edits.repartition(3), str(tmp_path), settings)
    assert again.ran == []
    sizes = {r["split"]: r["count"] for r in again.tables["predictions"].groupBy("split").count().collect()}
    assert sizes["test"] == n // 4 and sizes["val"] == n // 10 and sum(sizes.values()) == n
    metrics = {r.split: r for r in again.tables["evaluation"].collect()}
    assert metrics["test"].auc_roc > 0.8
    # the scorer that is read back scores like the stored predictions
    stored = {r.contribution_key: r.y_prob for r in again.tables["predictions"].collect()}
    scored = score_edits(edits, again.scorer).select("contribution_key", "y_prob").collect()
    assert all(abs(stored[r.contribution_key] - r.y_prob) < 1e-9 for r in scored) and len(scored) == n
    # fewer clusters: from the clustering on
    fewer = dataclasses.replace(settings, train=dataclasses.replace(train, clusters=3))
    ran = run_edits(edits, str(tmp_path), fewer).ran
    assert "clustering" in ran and "training" in ran and "preprocessing" not in ran and "feature_engineering" not in ran


def test_unknown_steps_are_refused():
    with pytest.raises(ValueError, match="unknown steps"):
        RunSettings(skip=("trainig",))


def test_comments_are_not_stored_with_the_features(spark, tmp_path):
    # ids that repeat or are missing keep their own comments
    rows = [(1, "x" * 5000, 1.0, 0), (1, "short", 2.0, 1), (2, None, None, 0), (None, "without id", 3.0, 1)]
    changesets = spark.createDataFrame(rows, "changeset_id long, comment string, min_lon double, label int").withColumns({
        "max_lon": F.col("min_lon") + 1, "min_lat": F.lit(10.0), "max_lat": F.lit(11.0)})
    scores = spark.createDataFrame([(1, 0.5)], "changeset_id long, predicted_prob double")
    found = runs.run_changesets(changesets, scores, str(tmp_path), RunSettings(skip=("data_splitting",)))
    assert found.ran == ["data_loading", "feature_engineering"]
    (folder,) = [p for p in tmp_path.iterdir() if p.name.startswith("feature_engineering-")]
    stored, whole = spark.read.parquet(str(folder)), found.tables["features"]
    assert "comment" not in stored.columns and whole.columns[:2] == ["changeset_id", "comment"]
    assert [r.asDict() for r in whole.drop("comment").orderBy("min_lon").collect()] == [r.asDict() for r in stored.orderBy("min_lon").collect()]
    assert sorted((r.comment or "", r.changeset_comment_length) for r in whole.collect()) == [("", 0), ("short", 5), ("without id", 10), ("x" * 5000, 5000)]
