"""Boosted trees and the stacked models, with Spark MLlib."""

from __future__ import annotations

import json
import os
import random
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.operators.metrics import areas
from editwarden.operators.running import HOT_ROWS
from editwarden.operators.sampling import SEED, assign_folds
from editwarden.session import scratch_path, settle

# Most rows in one of the files that the tree learner reads.
LEARN_ROWS = 1_000_000
# The ranges that the searches draw from.
SEARCH_GRID = {
    "learning_rate": [0.01, 0.05, 0.1, 0.2, 0.3],
    "max_depth": [3, 5, 7, 9],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    "lambda": [0, 1, 3, 5, 10],
    "alpha": [0, 1, 2, 3, 5],
    "min_child_weight": [1, 3, 5, 7, 10],
    "gamma": [0, 0.1, 0.3, 0.5, 1, 2, 3],
    "n_estimators": [50, 60, 80, 100],
    "scale_pos_weight": [0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 10, 50, 100, 250],
}
META_GRID = {
    "n_estimators": [100, 200, 500],
    "max_depth": [2, 3, 4, 5],
    "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "gamma": [0, 0.1, 0.2],
    "reg_alpha": [0, 0.01, 0.1],
    "reg_lambda": [1, 1.5, 2],
}
# gamma is a loss reduction summed over a node; MLlib only knows a gain per row (min_info_gain here), so it cannot stand for it
NO_COUNTERPART = ("lambda", "alpha", "reg_lambda", "reg_alpha", "gamma", "eval_metric")
PROFILE_FEATURES = (
    "num_contributions", "mean_prediction", "median_prediction", "std_prediction", "min_prediction", "max_prediction",
    "quantile_25", "quantile_75", "skewness_prediction", "kurtosis_prediction", "proportion_vandalism",
    "num_vandalism_predictions", "any_vandalism_prediction", "all_vandalism_predictions",
)


def tree_settings(params: Mapping) -> dict:
    """MLlib settings for parameters under their usual boosting names."""
    names = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
             "subsample": "subsamplingRate", "min_info_gain": "minInfoGain", "min_child_weight": "minInstancesPerNode"}
    out = {names[k]: v for k, v in params.items() if k in names}
    if "colsample_bytree" in params:
        out["featureSubsetStrategy"] = "all" if params["colsample_bytree"] >= 1 else str(params["colsample_bytree"])
    ignored = [k for k in params if k in NO_COUNTERPART and params[k]]
    if ignored:
        warnings.warn(f"no counterpart in MLlib, ignored: {ignored}", stacklevel=2)
    return out


def _inputs(features: Sequence[str]) -> list:
    """Stages that put the columns into one vector. They are numbered first: names may hold dots and spaces."""
    quoted = ["`" + f.replace("`", "``") + "`" for f in features]
    numbers = [f"_f{i}" for i in range(len(features))]
    named = ", ".join(f"{q} AS {n}" for q, n in zip(quoted, numbers))
    return [SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__"),
            VectorAssembler(inputCols=numbers, outputCol="_features", handleInvalid="keep")]


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with their feature columns as one vector ``_features``."""
    return PipelineModel(_inputs(features)).transform(df)


def with_inputs(trees: PipelineModel, features: Sequence[str]) -> PipelineModel:
    """Trees learnt from ``_features`` as a model of rows with the feature columns."""
    return PipelineModel([*_inputs(features), *trees.stages])


def fit_trees(rows: DataFrame, params: Mapping, label: str = "label", store: bool = True):
    """Boosted trees on rows with ``_features``; where there is a column ``_validate``, its rows stop the training early.

    ``store=False`` says that the rows are read from such files as ``_stored`` writes, or from an encoded table."""
    rows = _stored(rows) if store else rows
    return _trees(params, label, validate="_validate" in rows.columns).fit(_weighted(rows, label, params))


def _weighted(df: DataFrame, label: str, params: Mapping) -> DataFrame:
    weight = float(params.get("scale_pos_weight", 1))
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def _trees(params: Mapping, label: str, validate: bool = False) -> GBTClassifier:
    stop = {"validationIndicatorCol": "_validate", "validationTol": 0.001} if validate else {}
    return GBTClassifier(
        labelCol=label, featuresCol="_features", weightCol="_weight", seed=SEED, **stop, **tree_settings(params))


def fit_model(
    df: DataFrame, features: Sequence[str], params: Mapping, label: str = "label", split: str | None = None,
) -> PipelineModel:
    """Boosted trees. With ``split`` the rows named train are learnt from and those named val stop
    the training early."""
    rows = assembled(df.where(F.col(split).isin("train", "val")) if split else df, features)
    kept = [F.col("_features"), F.col(f"`{label}`")] + ([(F.col(split) == "val").alias("_validate")] if split else [])
    return PipelineModel([*_inputs(features), fit_trees(rows.select(*kept), params, label)])


def _stored(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows written once as Parquet, in folders of ``by``, and read from there.

    The tree learner reads its rows several times before it holds them, and holds each partition as one block. What is read from files comes in
    partitions of bounded size, whatever the scan was that the rows are made from."""
    path = scratch_path(rows.sparkSession, "learn")
    rows.write.option("maxRecordsPerFile", LEARN_ROWS).partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_vectors(df: DataFrame, features: Sequence[str], label: str, split: str, keep: Sequence[str] = ()) -> DataFrame:
    """(_features, label, keep, split), written once in a folder for each split, so that a side of the split is read alone."""
    return _stored(assembled(df, features).select("_features", label, *keep, split), [split])


def score(df: DataFrame, model: PipelineModel, out: str = "y_prob") -> DataFrame:
    """Probability of harm beside all columns of the row."""
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*added)


def _signatures(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """(y_true, margins, weight): the rows counted by the leaves they fall into; ``margins`` is the sum after each round.

    Every round of every row follows from its leaves, so all that comes after works on one row per combination of leaves."""
    trees = model.stages[-1]
    rows = PipelineModel(model.stages[:-1]).transform(df).select("_features", F.col(label).alias("y_true"))
    parts = []
    for i, (tree, weight) in enumerate(zip(trees.trees, trees.treeWeights)):
        tree.setFeaturesCol("_features").setPredictionCol(f"_t{i}")
        rows = tree.transform(rows)
        parts.append(F.col(f"_t{i}") * F.lit(float(weight)))
    counted = rows.groupBy("y_true", F.array(*parts).alias("_parts")).agg(F.count(F.lit(1)).alias("weight"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    added = F.aggregate("_parts", start, lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.array_append(s["all"], s["sum"] + v).alias("all")))
    # aggregates of several kinds read these rows; the trees are walked once
    return settle(counted.select("y_true", added["all"].alias("margins"), "weight"))


def _rounds(signatures: DataFrame) -> DataFrame:
    probability = 1 / (1 + F.exp(-2 * F.col("_m")))
    return signatures.select("y_true", "weight", F.posexplode("margins").alias("round", "_m")).select("round", "y_true", probability.alias("y_prob"), "weight")


def _losses(long: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("y_prob"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("y_true") == 1, F.log(p)).otherwise(F.log(1 - p))
    wrong = ((F.col("y_prob") >= 0.5).cast("int") != F.col("y_true")).cast("double")
    total = F.sum("weight")
    return long.groupBy("round").agg((F.sum(loss * F.col("weight")) / total).alias("logloss"), (F.sum(wrong * F.col("weight")) / total).alias("error"))


def training_curve(model: PipelineModel, df: DataFrame, label: str = "label", limit: int | None = HOT_ROWS) -> DataFrame:
    """Log loss, error, accuracy and AUC after each round, from one pass over the rows."""
    long = _rounds(_signatures(model, df, label))
    curve = areas(long, ["round"], F.col("weight"), limit).select(F.col("round").alias("_r"), F.col("auc_roc").alias("auc"))
    return _losses(long).join(curve, F.col("round") == F.col("_r")).drop("_r").withColumn("accuracy", 1 - F.col("error"))


def patient_round(losses: Sequence[float], patience: int) -> int:
    """The round (from 0) with the least loss among those seen before ``patience`` rounds in a row brought nothing better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def cut_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model of the first ``rounds`` trees."""
    trees = model.stages[-1]
    context = SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml
    all_trees = trees._java_obj.trees()
    some = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for i in range(rounds):
        some[i], weights[i] = all_trees[i], float(trees.treeWeights[i])
    made = ml.classification.GBTClassificationModel(trees.uid, some, weights, trees.numFeatures, 2)
    trees._java_obj.copyValues(made, ml.param.ParamMap())
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(made)])


def fit_patient(
    df: DataFrame, features: Sequence[str], params: Mapping, label: str = "label", split: str = "split", patience: int = 20,
) -> tuple[PipelineModel, DataFrame]:
    """(model, losses): trees learnt from the rows named train and cut to the best round on the rows named val.

    Boosting is additive, so the model after any round is a prefix of the full one: the losses of all prefixes come from one pass over
    the validation rows, and rounds are taken until ``patience`` of them in a row bring no lower log loss. Without validation rows
    all rounds stay and the table of losses is empty."""
    rows = assembled(df.where(F.col(split).isin("train", "val")), features).select("_features", label, split)
    model, losses = patient_trees(rows, params, label, split, patience)
    return with_inputs(model, features), losses


def patient_trees(
    rows: DataFrame, params: Mapping, label: str = "label", split: str = "split", patience: int = 20, store: bool = True,
) -> tuple[PipelineModel, DataFrame]:
    """As ``fit_patient``, on rows with ``_features``; the model has the trees only. ``store`` as in ``fit_trees``."""
    model = PipelineModel([fit_trees(rows.where(F.col(split) == "train").select("_features", label), params, label, store)])
    losses = settle(_losses(_rounds(_signatures(model, rows.where(F.col(split) == "val"), label))))
    found = {r["round"]: r["logloss"] for r in losses.collect()}  # one row per round
    if found:
        model = cut_rounds(model, patient_round([found[i] for i in sorted(found)], patience) + 1)
    return model, losses


def draw_parameters(grid: Mapping[str, Sequence] = SEARCH_GRID, n: int = 50, seed: int = SEED) -> list[dict]:
    """``n`` random settings of a grid that differ in what the trees can use."""
    used = [k for k in grid if k not in NO_COUNTERPART]
    size = 1
    for k in used:
        size *= len(grid[k])
    chance = random.Random(seed)
    drawn: dict[tuple, dict] = {}
    while len(drawn) < min(n, size):
        one = {k: chance.choice(list(v)) for k, v in grid.items()}
        drawn.setdefault(tuple(one[k] for k in used), one)
    return list(drawn.values())


def all_parameters(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def search(
    df: DataFrame, features: Sequence[str], settings: Sequence[Mapping], key: str, label: str = "label",
    folds: int = 5, parallelism: int = 4,
):
    """(best settings, table of settings and mean ROC-AUC) over stratified folds.

    ``parallelism`` fits run side by side. Settings that differ only in what the trees
    cannot use are fitted once."""
    distinct: dict[str, Mapping] = {}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for one in settings:
            distinct.setdefault(json.dumps([tree_settings(one), one.get("scale_pos_weight", 1)], sort_keys=True), one)
    settings = sorted(distinct.values(), key=lambda s: s.get("scale_pos_weight", 1))
    rows = assign_folds(df, key, folds, label).withColumn("fold", F.col("fold").cast("int"))
    rows = PipelineModel(_inputs(features)).transform(rows)
    # every setting and fold reads these rows, from a folder for each fold
    rows = _stored(rows.select("_features", label, "fold"), ["fold"])
    there = {r["fold"] for r in rows.select("fold").distinct().collect()}  # one row per fold
    if len(there) < folds or folds < 2:
        raise ValueError(f"rows in {len(there)} of {folds} folds")
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)

    def fitted(job):
        """ROC-AUC of one setting on one fold; nothing is fitted that the table does not need."""
        one, fold = job
        model = _trees(one, label).fit(_weighted(rows.where(F.col("fold") != fold), label, one))
        return evaluator.evaluate(model.transform(rows.where(F.col("fold") == fold)))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(fitted), [(s, f) for f in range(folds) for s in settings]))
    results = [(s, sum(found[i::len(settings)]) / folds) for i, s in enumerate(settings)]
    results.sort(key=lambda r: -r[1])
    table = df.sparkSession.createDataFrame(
        [(i, json.dumps(dict(s), sort_keys=True), float(a)) for i, (s, a) in enumerate(results)],
        "rank int, settings string, auc_roc double")
    return dict(results[0][0]), table


def random_search(df, features, key, label="label", grid=SEARCH_GRID, n=50, folds=5, parallelism=4):
    return search(df, features, draw_parameters(grid, n), key, label, folds, parallelism)


def grid_search(df, features, key, label="label", grid=META_GRID, folds=5, parallelism=4):
    return search(df, features, all_parameters(grid), key, label, folds, parallelism)


def cross_validate(df: DataFrame, features: Sequence[str], params: Mapping, key: str, label: str = "label", k: int = 5) -> DataFrame:
    """Average precision of each fold, the others training."""
    rows = _stored(assembled(assign_folds(df.select(key, label, *features), key, k, label), features).select("_features", label, "fold"))
    held = None
    for i in range(k):
        model = PipelineModel([fit_trees(rows.where(F.col("fold") != i), params, label, store=False)])
        part = score(rows.where(F.col("fold") == i), model).select("fold", F.col(label).alias("y_true"), "y_prob")
        held = part if held is None else held.unionByName(part)
    return areas(held, ["fold"]).select("fold", F.col("auc_pr").alias("score"))


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Per feature: number of splits (``weight``), their gain and the rows they divide, average and total.

    The gain of a split is its gain per row times the rows of the node times the weight of the tree, so a split near the root counts for
    all the rows it divides. The splits are read from the saved node table."""
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    trees = spark.read.parquet(os.path.join(path, "treesMetadata")).toDF("treeID", "metadata", "weights")
    node = spark.read.parquet(os.path.join(path, "data")).select("treeID", "nodeData.*").where("leftChild >= 0").join(trees, "treeID")
    gain = F.col("gain") * F.col("rawCount") * F.col("weights")
    splits = node.groupBy(F.col("split.featureIndex").alias("_i")).agg(
        F.avg(gain).alias("gain"), F.sum(gain).alias("total_gain"), F.count(F.lit(1)).cast("double").alias("weight"),
        F.avg("rawCount").cast("double").alias("cover"), F.sum("rawCount").cast("double").alias("total_cover"))
    names = spark.createDataFrame(list(enumerate(features)), "_i int, feature string")
    found = names.join(splits, "_i", "left")
    return found.select("feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gain", "total_gain", "weight", "cover", "total_cover")])


def fit_hyper(profiles: DataFrame, params: Mapping, label: str = "label", split: str = "split") -> PipelineModel:
    """Trees on the score profiles of changesets."""
    return fit_model(profiles, PROFILE_FEATURES, params, label, split)


def fit_meta(df: DataFrame, kind: str = "logistic_regression", params: Mapping | None = None, label: str = "y_true") -> PipelineModel:
    """The model that joins both probabilities."""
    inputs = ["y_prob_main", "y_prob_hyper"]
    if kind == "trees":
        return fit_model(df, inputs, params or {}, label)
    if kind != "logistic_regression":
        raise ValueError(f"unknown kind {kind}")
    assembler = VectorAssembler(inputCols=inputs, outputCol="_features")
    # the usual default penalty: half a squared norm against the sum of losses
    strength = 1.0 / max(df.count(), 1)
    regression = LogisticRegression(labelCol=label, featuresCol="_features", regParam=strength, standardization=False)
    return Pipeline(stages=[assembler, regression]).fit(df)


def save_model(model: PipelineModel, path: str, spark, **facts) -> None:
    """Model with what scoring needs beside it: columns, centres, vocabularies, threshold."""
    model.write().overwrite().save(os.path.join(path, "model"))
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").coalesce(1).write.mode(
        "overwrite").text(os.path.join(path, "facts"))


def load_model(path: str, spark) -> tuple[PipelineModel, dict]:
    facts = json.loads(spark.read.text(os.path.join(path, "facts")).first()[0])
    return PipelineModel.load(os.path.join(path, "model")), facts
