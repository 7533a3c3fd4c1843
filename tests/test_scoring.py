"""The monthly and the daily job with a trained model, stored totals, reruns."""

import os

import pytest
from pyspark.sql import functions as F

from checks.learning import small_training
from editwarden.operators.aggregates import monthly_summary
from editwarden.plans.scoring import Scorer, SummaryStore, merge_summary, score_edits, score_months
from editwarden.sources.writers import write_flagged
from editwarden.streaming import daily

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    df, result = small_training(spark, SF)
    path = str(tmp_path_factory.mktemp("model"))
    result.scorer.save(path, spark)
    source = str(tmp_path_factory.mktemp("edits") / "edits")
    df.write.parquet(source)
    return spark.read.parquet(source), path


def scores(df):
    return {r.contribution_key: (str(r.month), r.y_pred, round(r.y_prob, 9)) for r in df.collect()}


def test_stream_scores_like_the_monthly_job_and_counts_once(spark, trained, tmp_path):
    edits, model = trained
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in ("osm_version <= 2", "osm_version > 2"):
        edits.where(part).repartition(2).write.mode("append").parquet(source)
        daily.score_new_files(spark, source, edits.schema, model, out, check, files_per_batch=1)
    store = daily.score_new_files(spark, source, edits.schema, model, out, check)  # nothing new
    flagged, summary = score_months(edits, Scorer.load(model, spark), str(tmp_path / "monthly"))
    assert scores(spark.read.parquet(os.path.join(out, "scores"))) == scores(spark.read.parquet(str(tmp_path / "monthly" / "scores"))) == scores(
        score_edits(edits, Scorer.load(model, spark)))
    totals = {str(r.month): (r.total_entries, r.vandalism_count, r.vandalism_percentage) for r in store.read().collect()}
    assert totals == {str(r.month): (r.total_entries, r.vandalism_count, r.vandalism_percentage) for r in summary.collect()}
    assert daily.stored_batches(spark, out).count() == flagged.count() > 0
    assert store.runs() == {f"batch={i}" for i in range(len(store.runs()))}


def test_a_lost_checkpoint_adds_no_batch_twice(spark, trained, tmp_path):
    edits, model = trained
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    edits.coalesce(1).write.parquet(source)
    for check in ("a", "b"):
        store = daily.score_new_files(spark, source, edits.schema, model, out, str(tmp_path / check))
    assert store.read().agg(F.sum("total_entries")).first()[0] == edits.count()


def test_summary_store(spark, tmp_path, monkeypatch):
    def summary(*rows):
        return monthly_summary(spark.createDataFrame([(m, p) for m, p, n in rows for _ in range(n)], "month string, y_pred int"))

    def read(store):
        return sorted((r.month, r.total_entries, r.vandalism_count, r.vandalism_percentage) for r in store.read().collect())

    store = SummaryStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.runs() == set()
    store.add("a", summary(("2024-01", 0, 3), ("2024-01", 1, 1)))
    store.add("b", summary(("2024-01", 1, 4), ("2024-02", 0, 2)))
    wanted = [("2024-01", 8, 5, "62.5000"), ("2024-02", 2, 0, "0.0000")]
    assert read(store) == wanted
    store.add("b", summary(("2024-01", 1, 4), ("2024-02", 0, 2)))
    assert read(SummaryStore(spark, str(tmp_path / "s"))) == wanted

    # a run that dies between summary and list of runs changes nothing, and can be repeated
    monkeypatch.setattr(SummaryStore, "_named", lambda self, runs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.add("c", summary(("2024-03", 1, 1)))
    assert read(store) == wanted and store.runs() == {"a", "b"}
    monkeypatch.undo()
    store.add("c", summary(("2024-03", 1, 1)))
    assert read(store) == [*wanted, ("2024-03", 1, 1, "100.0000")] and store.runs() == {"a", "b", "c"}
    store.add("d", summary(("2024-01", 0, 1)), mode="replace")
    assert read(store)[0] == ("2024-01", 1, 0, "0.0000")
    assert len(store._numbers()) == 2  # the newest and the one before


def test_a_rerun_replaces_its_months(spark, trained, tmp_path):
    edits, model = trained
    scorer, out = Scorer.load(model, spark), str(tmp_path / "out")
    score_months(edits, scorer, out)
    before = scores(spark.read.parquet(os.path.join(out, "scores")))
    _, summary = score_months(edits, scorer, out)
    assert scores(spark.read.parquet(os.path.join(out, "scores"))) == before
    assert summary.agg(F.sum("total_entries")).first()[0] == len(before)
    # one month again, with nothing flagged any more: its old flagged rows go, other months stay
    month = sorted({m for m, *_ in before.values()})[0]
    some = edits.where(F.date_format("valid_from", "yyyy-MM") == month[:7])
    flagged, summary = score_months(some, Scorer(scorer.model, scorer.columns, scorer.encoder, scorer.centers, 2.0, scorer.settings), out)
    left = {str(r.month) for r in flagged.select("month").distinct().collect()}
    assert month not in left and left == {m for m, p, _ in before.values() if p} - {month}
    assert {str(r.month): r.vandalism_count for r in summary.collect()}[month] == 0
    assert len(scores(spark.read.parquet(os.path.join(out, "scores")))) == len(before)


def test_writers_keep_other_months(spark, tmp_path):
    path = str(tmp_path / "s")
    for month, n in (("2024-01", 2), ("2024-02", 3), ("2024-01", 5)):
        merge_summary(monthly_summary(spark.createDataFrame([(month, 1)] * n, "month string, y_pred int")), path)
    assert sorted((str(r.month)[:7], r.total_entries) for r in spark.read.parquet(path).collect()) == [("2024-01", 5), ("2024-02", 3)]
    flagged = str(tmp_path / "f")
    write_flagged(spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "id int, month string"), flagged, covered=["2024-01", "2024-02"])
    write_flagged(spark.createDataFrame([(3, "2024-02")], "id int, month string"), flagged, covered=["2024-01", "2024-02"])
    assert [r.id for r in spark.read.parquet(flagged).collect()] == [3]
