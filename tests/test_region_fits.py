import pytest
from pyspark.sql import functions as F

from editwarden.operators.models import fit_model, importances
from editwarden.plans import region_fits
from editwarden.plans.ledger import Ledger, StepRunner, content_key, fingerprint
from editwarden.plans.region_fits import fit_combination, fit_combinations, region_bits

REGIONS = ["A", "B", "C", "D"]
TREES = {"n_estimators": 2, "max_depth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    where = F.when(F.col("id") % 7 == 0, F.array(F.lit("A"), F.lit("C"))).when(F.col("id") % 11 == 0, F.array(F.lit("Z"))).when(
        F.col("id") % 13 == 0, F.lit(None)).otherwise(F.array(F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("id") % 4 + 1).cast("int"))))
    return spark.range(600).select(
        "id", (F.col("id") % 10).cast("double").alias("x.y"), F.rand(3).alias("z"), (F.col("id") % 10 >= 5).cast("int").alias("label"), where.alias("regions"))


def run(rows, folder, **more):
    return fit_combinations(rows, ["x.y", "z"], TREES, folder, "label", "regions", REGIONS, 1, 2, **more)


def test_every_combination_is_fitted_once(spark, rows, tmp_path):
    folder, fitted = str(tmp_path), []

    def until_killed(rows, masks, *more):
        if len(fitted) == 5:
            raise KeyboardInterrupt  # not an Exception: the run dies
        fitted.append(masks)
        return fit_combination(rows, masks, *more)

    with pytest.raises(KeyboardInterrupt):
        run(rows, folder, parallel=1, fit=until_killed)
    assert len(fitted) == 5
    again = []

    def failing_once(rows, masks, *more):
        again.append(masks)
        if len(again) == 3:
            raise ValueError("no memory")
        return fit_combination(rows, masks, *more)

    with pytest.warns(UserWarning, match="no memory"):
        out = run(rows, folder, fit=failing_once)
    # 36 ways to give four regions to three groups of one or two; those of the first run are not fitted again
    assert len(again) == 31 and not set(again) & set(fitted)
    assert [r.error for r in out.where("TN IS NULL").collect()] == ["ValueError: no memory"]
    last = []
    out = run(rows, folder, fit=lambda r, masks, *more: last.append(masks) or fit_combination(r, masks, *more)).collect()
    assert last == [again[2]] and len(out) == 36
    plain = rows.collect()
    for r in out:
        inside = lambda group: [p for p in plain if p.regions and set(p.regions) & set(group)]  # noqa: E731, B023
        test = inside(r.test_regions)
        assert (r.n_train, r.n_val, r.n_test) == (len(inside(r.train_regions)), len(inside(r.val_regions)), len(test))
        # the label follows from one feature: each model finds it
        assert (r.TP, r.TN, r.FP, r.FN) == (sum(p.label for p in test), sum(1 - p.label for p in test), 0, 0) and r.accuracy == 1.0
        assert r.error is None and r.rounds >= 1


def test_other_rows_or_settings_are_fitted_anew(spark, rows, tmp_path):
    counted = []
    fit = lambda *a: counted.append(1) or {"n_train": 0, "n_val": 0, "n_test": 0, "TN": 0, "FP": 0, "FN": 0, "TP": 0, "rounds": 1}
    for df in (rows, rows.repartition(3), rows.where("id > 0")):
        fit_combinations(df, ["z"], TREES, str(tmp_path), "label", "regions", REGIONS[:3], 1, 1, fit=fit)
    fit_combinations(rows, ["z"], TREES | {"max_depth": 3}, str(tmp_path), "label", "regions", REGIONS[:3], 1, 1, fit=fit)
    assert len(counted) == 3 * 6


def test_region_bits(spark):
    df = spark.createDataFrame([(["A", "C"],), ([],), (None,), (["Z"],), (["D", "D"],)], "r array<string>")
    assert [r[0] for r in df.select(region_bits("r", REGIONS)).collect()] == [5, 0, 0, 0, 8]
    with pytest.raises(ValueError):
        region_bits("r", [str(i) for i in range(63)])
    assert region_fits.MOST_REGIONS == 62


def test_importances_weigh_splits_by_their_rows(spark, rows):
    """Of one tree, the gains in shares are MLlib's own importances."""
    noisy = rows.withColumn("label", F.when(F.col("id") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    model = fit_model(noisy, ["z", "x.y"], {"n_estimators": 1, "max_depth": 4})
    found = {r.feature: r for r in importances(model, ["z", "x.y"], spark).collect()}
    total = sum(r.total_gain for r in found.values())
    own = model.stages[-1].featureImportances.toArray()
    assert [found[f].total_gain / total for f in ("z", "x.y")] == pytest.approx(list(own), abs=1e-9)
    assert all(abs(r.gain * r.weight - r.total_gain) < 1e-6 for r in found.values())


def test_ledger_and_steps(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "a int, b string")
    assert ledger.read().count() == 0
    ledger.write("x", (1, "u"))
    ledger.write("x", (2, None))
    (tmp_path / "l" / "half").mkdir()
    assert ledger.names() == {"x"} and [tuple(r) for r in ledger.read().collect()] == [(2, None)]
    df = spark.range(5)
    assert content_key(df) == content_key(df.repartition(3)) != content_key(spark.range(6))
    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1}) != fingerprint({"a": 1, "b": 3})

    def steps(setting, skip=()):
        runner = StepRunner(spark, str(tmp_path / "s"), content_key(df), skip)
        a = runner.table("a", lambda: df.withColumn("s", F.lit(setting)), setting)
        b = runner.facts("b", lambda: {"n": a.count()}, needs=["a"])
        return runner.ran, None if b is None else b["n"], a

    assert steps(1)[:2] == (["a", "b"], 5) and steps(1)[:2] == ([], 5)
    assert steps(2)[0] == ["a", "b"] and steps(1)[0] == []
    ran, n, a = steps(3, skip=["a"])
    assert ran == [] and n is None and a is None


def test_a_fit_reads_the_folders_of_its_regions_only(spark, rows, tmp_path):
    seen = []

    def fit(encoded, masks, params, label, threshold):
        side = encoded.where(region_fits._within(masks[0])).select("_features", label, F.lit(False).alias("_validate"))
        both = side.unionByName(encoded.where(region_fits._within(masks[1])).select("_features", label, F.lit(True).alias("_validate")))
        files = [r[0] for r in both.where("NOT _validate").select(F.input_file_name()).distinct().collect()]
        seen.append((masks[0], {int(f.split("_bits=")[1].split("/")[0]) for f in files}))
        plan = both.where("NOT _validate")._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and "Generate" not in plan
        return {"n_train": 0, "n_val": 0, "n_test": 0, "TN": 0, "FP": 0, "FN": 0, "TP": 0, "rounds": 1}

    out = run(rows, str(tmp_path), fit=fit)
    assert out.where("error IS NOT NULL").count() == 0
    # rows of A and C have the bits 5
    assert len(seen) == 36 and all(found == {b for b in (1, 2, 4, 5, 8) if b & mask} for mask, found in seen)


def test_fewer_fits_run_side_by_side_on_more_rows(rows, monkeypatch):
    assert region_fits._side_by_side(rows, 4) == 4
    for held, fits in ((1800, 3), (1199, 1), (10, 1)):
        monkeypatch.setattr(region_fits, "ROWS_HELD", held)
        assert region_fits._side_by_side(rows, 4) == fits
