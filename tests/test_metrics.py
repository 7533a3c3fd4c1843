import random

import pytest
from pyspark.sql import functions as F

from editwarden.operators import bootstrap as B
from editwarden.operators import metrics as V
from editwarden.operators import regions
from editwarden.operators.rows import flag


def scored(n=400, seed=3):
    chance = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(chance.random() < 0.3)
        rows.append((f"k{i}", y, min(1.0, round(chance.random() * 0.7 + 0.3 * y, 2)), "a" if i % 3 else "b"))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(scored(), "ck string, y_true int, y_prob double, g string")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, ap = sum(y for y, _ in pairs), 0.0
    for s in {p for _, p in pairs}:
        shown = [y for y, p in pairs if p >= s]
        ap += sum(shown) / len(shown) * sum(y for y, p in pairs if p == s) / total
    return ap


@pytest.mark.parametrize("limit", [None, 5])
def test_areas(table, limit):
    rows = scored()
    found = V.areas(table, ["g"], limit=limit).collect()
    for r in found:
        pairs = [(y, p) for _, y, p, g in rows if g == r["g"]]
        assert abs(r["auc_roc"] - brute_auc(pairs)) < 1e-9 and abs(r["auc_pr"] - brute_ap(pairs)) < 1e-9


def test_curves_are_the_same_in_chunks(table):
    def rounded(df):
        return sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    for curve in (V.roc_curve, V.pr_curve):
        assert rounded(curve(table)) == rounded(curve(table, limit=7))


def test_one_class_and_constant_scores(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y_true int, y_prob double")
    assert tuple(V.areas(one).first()) == (None, None)
    same = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y_true int, y_prob double")
    assert V.areas(same).first()["auc_roc"] == 0.5
    assert flag(same).agg(F.sum("y_pred")).first()[0] == 2  # exactly at the threshold counts
    empty = same.limit(0)
    assert V.best_threshold(empty).first()["threshold"] == 0.5
    assert tuple(V.binary_metrics(flag(empty)).first())[-1] == 0.0


def test_published_confusion_counts(spark):
    counts = spark.createDataFrame([(119106, 894, 15, 29985)], "TN long, FP long, FN long, TP long")
    row = V.with_metrics(counts).first()
    assert round(row["accuracy"], 4) == 0.9939


def test_best_threshold(table):
    rows = scored()
    def f1(t):
        tp = sum(1 for _, y, p, _ in rows if p >= t and y)
        shown, total = sum(1 for r in rows if r[2] >= t), sum(r[1] for r in rows)
        p, r = tp / shown, tp / total
        return 2 * p * r / (p + r + 1e-9)
    best = max(sorted({r[2] for r in rows}), key=lambda t: (round(f1(t), 12), -t))
    assert V.best_threshold(table).first()["threshold"] == best


def test_regional_report_with_one_class_region(spark):
    df = spark.createDataFrame(
        [(["x", "y"], 1, 1, 0.9), (["y"], 0, 1, 0.6), (["y"], 0, 0, 0.1)], "r array<string>, y_true int, y_pred int, y_prob double")
    rows = {r["region"]: r for r in V.regional_report(df, "r").collect()}
    assert rows["x"]["auc_roc"] is None and rows["x"]["accuracy"] == 1.0
    assert rows["y"]["total"] == 3 and rows["y"]["auc_roc"] == 1.0 and rows["y"]["incorrect"] == 1


def test_bootstrap_weights_add_up(spark, table):
    counts = B.resampled_counts(flag(table), "ck", 5)
    assert {r["n"] for r in counts.groupBy("iteration").agg(F.sum("weight").alias("n")).collect()} == {400}
    odd = B.resampled_counts(flag(table).where("ck <> 'k0'"), "ck", 3)
    assert {r["n"] for r in odd.groupBy("iteration").agg(F.sum("weight").alias("n")).collect()} == {399}
    wide = B.resampled_counts(flag(table), "ck", 20, poisson=True).agg(F.sum("weight")).first()[0]
    assert abs(wide / 20 - 400) < 40


def test_bootstrap_is_reproducible_and_near_the_truth(table):
    a = B.bootstrap(flag(table), "ck", 30)
    assert sorted(a.collect()) == sorted(B.bootstrap(flag(table.repartition(7)), "ck", 30).collect())
    mean = {r["metric"]: r["mean"] for r in B.bootstrap_summary(a).collect()}
    assert abs(mean["AUC-ROC"] - V.areas(table).first()["auc_roc"]) < 0.02
    assert {r["normal"] for r in B.bootstrap_shape(a).collect()} <= {"Yes", "No"}


def test_normality_of_a_normal_sample(spark):
    # values of the usual omnibus test for skewness 0.2, excess kurtosis 0.1 and n = 1000
    df = spark.createDataFrame([(1000.0, 0.0, 0.0), (1000.0, 0.5, 1.0)], "n double, g double, k double")
    p = [r[0] for r in df.select(B.normality_p(F.col("n"), F.col("g"), F.col("k"))).collect()]
    assert p[0] > 0.9 and p[1] < 1e-6


def test_region_combinations(spark):
    combos = regions.region_combinations(spark)
    assert combos.count() == 1680
    df = spark.createDataFrame([(["Asia", "Africa"], 1, 1), (["Other"], 0, 1)], "continents array<string>, y_true int, y_pred int")
    report = regions.geo_combo_report(df)
    row = report.where(F.array_contains("test_regions", "Asia") & F.array_contains("test_regions", "Africa")).first()
    assert row["TP"] == 1  # a row in two test regions counts once
    assert report.count() == 1680
