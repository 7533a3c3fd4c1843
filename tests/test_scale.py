"""Work that must not end in one task, however large the table is."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from checks import all_checks, jobs
from editwarden.operators import bootstrap, models, sampling
from editwarden.plans import features, training
from editwarden.session import scratch_path
from editwarden.sources import writers


def sizes(spark, path):
    return [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]


def test_compact_bounds_the_rows_of_a_file(spark, tmp_path):
    path = str(tmp_path / "compact")
    writers.compact(spark.range(400).withColumn("ck", F.col("id").cast("string")), path, 2, "ck", most=50)
    assert sum(sizes(spark, path)) == 400 and len(sizes(spark, path)) == 8


def test_daily_files_of_a_large_year_are_several(spark, tmp_path, monkeypatch):
    rows = spark.range(300).select(F.col("id").cast("string").alias("ck"), F.lit(datetime.datetime(1996, 1, 1)).alias("date_created"))
    monkeypatch.setattr(jobs, "narrow", lambda spark, sf: rows)
    path = jobs.daily_files(spark, "", most=20)
    assert sum(sizes(spark, path)) == 300 and max(sizes(spark, path)) <= 20


def test_rows_to_learn_from_are_written_once_in_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(models, "LEARN_ROWS", 30)
    written = []
    stored = models._stored
    monkeypatch.setattr(models, "_stored", lambda rows: written.append(stored(rows)) or written[-1])
    df = spark.range(120).coalesce(1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"),
                                             F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    model = models.fit_model(df, ["x"], {"n_estimators": 2, "max_depth": 2}, split="split")
    assert [w.count() for w in written] == [120] and len(written[0].inputFiles()) == 4
    assert models.score(df, model).where((F.col("y_prob") > 0.5) == (F.col("label") == 1)).count() == 120


def test_draws_are_hashed_and_not_sorted(spark):
    df = spark.range(500).select(F.col("id").alias("ck"), (F.col("id") % 2).alias("y_true"), (F.col("id") % 3 % 2).alias("y_pred"), (F.col("id") % 10 / 10).alias("y_prob"))
    small, large = (bootstrap.resampled_counts(df, "ck", 3, broadcast=b) for b in (1_000, 0))
    assert "shuffledhashjoin" in large._jdf.queryExecution().executedPlan().toString().lower()
    assert small.exceptAll(large).count() == 0 and small.count() == large.count()


def test_user_documents_are_parsed_on_all_cores(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = all_checks()[0]["F26_user_info"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 40


@pytest.mark.parametrize("n", [1, 701])
def test_packed_draws_count_like_single_ones(spark, n):
    df = spark.range(n).select(
        F.when(F.col("id") != 5, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("ck"),  # numbered first, and left out
        F.when(F.col("id") % 50 != 3, F.col("id") % 2).alias("y_true"), (F.col("id") % 3 % 2).cast("int").alias("y_pred"),
        F.when(F.col("id") % 40 != 7, F.col("id") % 10 / 10).alias("y_prob"))
    single = bootstrap.resampled_counts(df, "ck", 4)
    skipped, sizes = sampling.bucket_sizes(df, "ck")
    assert (skipped, sum(sizes)) == (n > 5, n - (n > 5))
    for rows, most in ((10 ** 6, 10 ** 6), (40, 300)):
        packed = bootstrap.packed_counts(df, "ck", sizes, 4, skipped=skipped, rows=rows, most=most)
        assert packed.exceptAll(single).count() == 0 and packed.count() == single.count() and packed.dtypes == single.dtypes


def test_many_draws_are_packed(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("ck"), (F.col("id") % 2).alias("y_true"), (F.col("id") % 3 % 2).alias("y_pred"), (F.col("id") % 10 / 10).alias("y_prob"))
    few, many = (bootstrap.resampled_counts(df, "ck", 2, single=single) for single in (6000, 5999))
    names = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
    assert "FlatMapCoGroupsInArrow" in names[1] and "FlatMapCoGroupsInArrow" not in names[0] and "Join" not in names[1]
    assert few.exceptAll(many).count() == 0 == many.exceptAll(few).count()


def test_training_builds_its_features_once_and_scores_once(spark, monkeypatch):
    """The features are stored while they are needed, vectors in a folder for each split; threshold, metrics and predictions read stored scores."""
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("contribution_key"), (F.col("id") % 40).alias("changeset_id"), (F.col("id") % 2).alias("vandalism"),
        (F.col("id") % 2 * 3 + F.col("id") % 5 % 2).cast("double").alias("x"), (F.col("id") % 20).cast("double").alias("centroid_x"),
        (F.col("id") % 9).cast("double").alias("centroid_y"), F.when(F.col("id") % 3 == 0, "node").otherwise("way").alias("osm_type"))
    seen, paths, scored = spark.sparkContext.accumulator(0), [], []
    monkeypatch.setattr(training, "build_features", lambda edits, settings: edits.rdd.map(lambda r: seen.add(1) or r).toDF(edits.schema))
    monkeypatch.setattr(training, "scratch_path", lambda s, name: paths.append(scratch_path(s, name)) or paths[-1])
    monkeypatch.setattr(training, "score", lambda df, model: scored.append(df) or models.score(df, model))
    result = training.train_run(rows, training.TrainSettings(test=80, val=40, ratio=0.5, clusters=3, params={"n_estimators": 2, "max_depth": 2}))
    found = result.predictions.groupBy("split").count().collect()
    assert seen.value == 400 and {r["split"]: r["count"] for r in found} == {"train": 280, "val": 40, "test": 80}
    assert [r["auc_roc"] for r in result.metrics.collect()] == [1.0] * 3
    features, predictions = paths
    assert not os.path.exists(features) and spark.read.parquet(predictions).count() == 400
    folders = {f.split("_keep_split=")[1].split("/")[0] for f in scored[0].inputFiles()}
    assert len(scored) == 1 and folders == {"train", "val", "test"}
    # the model takes rows with the feature columns, as before
    again = models.score(scored[0].select(F.col("_keep_contribution_key").alias("contribution_key")).join(
        rows, "contribution_key").withColumns({"osm_type_node": F.lit(0), "osm_type_way": F.lit(0), "cluster_label": F.lit(0)}), result.scorer.model)
    assert again.where((F.col("y_prob") > 0.5) == (F.col("vandalism") == 1)).count() == 400


def test_stored_features_are_packed_tightly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "build_features", lambda df, settings: df)
    path = str(tmp_path / "features")
    assert features.features_or_load(spark.range(10), path).count() == 10
    assert all(name.endswith(".zstd.parquet") for name in os.listdir(path) if name.startswith("part-"))


def test_a_search_fits_each_setting_on_each_fold_and_no_more(spark, monkeypatch):
    df = spark.range(600).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("double").alias("x"), F.rand(1).alias("y"),
                                 (F.col("id") % 10 > 4).cast("int").alias("label"))
    fits, trees = [], models._trees
    monkeypatch.setattr(models, "_trees", lambda params, *more, **named: fits.append(dict(params)) or trees(params, *more, **named))
    settings = [{"n_estimators": 1, "max_depth": d, "scale_pos_weight": w} for d, w in ((1, 1), (2, 1), (2, 3))]
    best, table = models.search(df, ["x", "y"], settings, "k", folds=3)
    assert sorted(map(str, fits)) == sorted(str(s) for s in settings * 3)
    assert table.count() == 3 and best in settings and table.agg(F.min("auc_roc")).first()[0] == 1.0
    with pytest.raises(ValueError, match="folds"):
        models.search(df.where("x < 0"), ["x", "y"], settings, "k", folds=3)
