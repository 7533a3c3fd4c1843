"""The scoring job: edits with history in, flagged edits and month summary out."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwarden.functions.times import month_label
from editwarden.operators.aggregates import monthly_summary
from editwarden.operators.clusters import assign_clusters
from editwarden.operators.encoders import EditEncoder
from editwarden.operators.models import load_model, save_model, score
from editwarden.operators.rows import FLAGGED_COLUMNS, align_columns, flag
from editwarden.operators.tables import upsert_summary
from editwarden.plans.features import FeatureSettings, build_features
from editwarden.plans.ledger import folders, remove
from editwarden.sources.writers import write_flagged, write_table

CARRIED = ("contribution_key", "osm_id", "date_created")


@dataclass
class Scorer:
    """Everything training leaves behind for scoring."""

    model: PipelineModel
    columns: list[str]
    encoder: EditEncoder
    centers: list[tuple[int, float, float]]
    threshold: float = 0.5
    settings: FeatureSettings = field(default_factory=FeatureSettings)

    def save(self, path: str, spark) -> None:
        save_model(
            self.model, path, spark, columns=self.columns, multi=self.encoder.multi, categories=self.encoder.categories, temporal=self.encoder.temporal,
            centers=self.centers, threshold=self.threshold, settings=vars(self.settings))

    @classmethod
    def load(cls, path: str, spark) -> Scorer:
        model, facts = load_model(path, spark)
        return cls(
            model, facts["columns"], EditEncoder(facts["multi"], facts["categories"], facts.get("temporal", False)), [tuple(c) for c in facts["centers"]],
            facts["threshold"], FeatureSettings(**facts["settings"]))


def score_edits(edits: DataFrame, scorer: Scorer) -> DataFrame:
    """Score each edit. The whole plan is one narrow stage: no shuffle, and ids stay on their row."""
    rows = build_features(edits, scorer.settings, training=False)
    rows = scorer.encoder.transform(rows, keep=CARRIED)
    rows = assign_clusters(rows, scorer.centers)
    ids = ("changeset_id", "osm_version", "centroid_x", "centroid_y")
    kept = {c: f"_keep_{c}" for c in CARRIED} | {c: f"_id_{c}" for c in ids}
    rows = rows.withColumns({f"_id_{c}": F.col(c) for c in ids})
    rows = align_columns(rows, scorer.columns, keep=list(kept.values()))
    rows = flag(score(rows, scorer.model), scorer.threshold)
    out = rows.select(*[F.col(name).alias(c) for c, name in kept.items()], "y_prob", "y_pred")
    return out.withColumn("month", month_label(F.col("date_created")))


def score_months(edits: DataFrame, scorer: Scorer, out: str) -> tuple[DataFrame, DataFrame]:
    """Score all months in one job: (flagged edits, month summary), both also written under ``out``.

    The scores are written once, by month; flagged edits and summary read them from there. The months of this run replace
    those of earlier runs in all three, also when nothing is flagged any more; other months stay."""
    spark = edits.sparkSession
    months = [r["month"] for r in edits.select(month_label(F.col("valid_from")).alias("month")).distinct().collect()]
    scored = score_edits(edits, scorer)
    write_table(scored, os.path.join(out, "scores"), ["month"])
    scores = spark.read.schema(scored.schema).parquet(os.path.join(out, "scores")).where(F.col("month").isin(months))
    write_flagged(scores.where("y_pred = 1").select(*FLAGGED_COLUMNS, "month"), os.path.join(out, "flagged"), covered=months)
    merge_summary(monthly_summary(scores), os.path.join(out, "summary"))
    return spark.read.parquet(os.path.join(out, "flagged")), spark.read.parquet(os.path.join(out, "summary"))


def merge_summary(new: DataFrame, path: str) -> None:
    """Replace the months of this run in the stored summary (partition overwrite, one file a month)."""
    new = new.withColumn("updated_at", F.current_timestamp())
    new.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


class SummaryStore:
    """A stored month summary to which each run is added once.

    Every addition writes a new generation: the summary and the names of the runs in it, the latter last and in one job. The newest whole
    generation counts, so a run that dies half-way changes nothing, and a repeated run finds its name and adds nothing. One writer at a
    time; older generations go, but for the last one, which a reader may still hold."""

    RUNS = "run string, added timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self) -> list[int]:
        """Whole generations: those whose list of runs is finished."""
        names = folders(self.spark, os.path.join(self.path, "runs"))
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))

    def _folder(self, what: str, number: int) -> str:
        return os.path.join(self.path, what, f"generation={number}")

    def runs(self) -> set[str]:
        numbers = self._numbers()
        if not numbers:
            return set()
        return {r["run"] for r in self.spark.read.schema(self.RUNS).parquet(self._folder("runs", numbers[-1])).collect()}  # one row per run

    def read(self) -> DataFrame | None:
        """The summary after all runs, or None before the first."""
        numbers = self._numbers()
        return self.spark.read.parquet(self._folder("summary", numbers[-1])) if numbers else None

    def add(self, run: str, new: DataFrame, mode: str = "add") -> DataFrame:
        """The summary with this run merged in (counts added, or its months replaced); a run that was added before changes nothing."""
        numbers, old, runs = self._numbers(), self.read(), self.runs()
        if run in runs:
            return old
        number = (numbers[-1] if numbers else 0) + 1
        merged = upsert_summary(new.limit(0) if old is None else old, new.withColumn("updated_at", F.current_timestamp()), mode)
        for what, table in (("summary", merged), ("runs", self._named({*runs, run}))):
            table.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._folder(what, number))
        for past in numbers[:-1]:
            # first what makes the generation count, then what it holds
            remove(self.spark, self._folder("runs", past))
            remove(self.spark, self._folder("summary", past))
        return self.read()

    def _named(self, runs: set[str]) -> DataFrame:
        return self.spark.createDataFrame([(r,) for r in sorted(runs)], "run string").withColumn("added", F.current_timestamp())
