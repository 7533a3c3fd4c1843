"""Metrics of binary predictions as DataFrame queries, overall or per group.

Input: ``y_true`` (0/1), ``y_pred`` (0/1) and ``y_prob``; ``weight`` counts a row more than once.
The curves first collapse the table to one row per (group, score) with partial aggregation; the
running sums over the scores go through ``running`` and so never sort a large group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwarden.operators.running import HOT_ROWS, running
from editwarden.session import settle

METRICS = ("accuracy", "precision", "recall", "f1_score")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """TN, FP, FN and TP."""
    w = F.lit(1) if weight is None else weight
    def cell(true, pred):
        hit = (F.col("y_true") == true) & (F.col("y_pred") == pred)
        return F.coalesce(F.sum(F.when(hit, w)), F.lit(0)).cast("bigint")

    return df.groupBy(*by).agg(
        cell(0, 0).alias("TN"), cell(0, 1).alias("FP"), cell(1, 0).alias("FN"), cell(1, 1).alias("TP"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("TN", "FP", "FN", "TP"))
    return counts.withColumns({
        "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def binary_metrics(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    return with_metrics(confusion(df, by, weight))


def score_counts(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Positives and negatives per (group, score)."""
    w = F.lit(1) if weight is None else weight
    positive = F.col("y_true") == 1
    return df.groupBy(*by, "y_prob").agg(
        F.sum(F.when(positive, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(positive, 0).otherwise(w)).cast("bigint").alias("neg"))


def ranked_scores(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None, limit: int | None = HOT_ROWS) -> DataFrame:
    """Score counts with the counts at lower scores (``pos_below``, ``neg_below``) and the totals."""
    counts = score_counts(df, by, weight)
    if limit is not None:
        # the size check below and the running sums should not compute the scores twice
        counts = settle(counts)
    rows = running(
        counts, list(by), ["y_prob"],
        sums={"_pos": F.col("pos"), "_neg": F.col("neg")},
        totals={"all_pos": F.col("pos"), "all_neg": F.col("neg")}, limit=limit)
    return rows.withColumns({
        "pos_below": F.col("_pos") - F.col("pos"), "neg_below": F.col("_neg") - F.col("neg"),
    }).drop("_pos", "_neg")


def areas(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None, limit: int | None = HOT_ROWS) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null for groups with one class."""
    rows = ranked_scores(df, by, weight, limit)
    pairs = F.col("pos") * (F.col("neg_below").cast("double") + F.col("neg") / F.lit(2.0))
    hits = (F.col("all_pos") - F.col("pos_below")).cast("double")
    shown = (F.col("all_pos") + F.col("all_neg") - F.col("pos_below") - F.col("neg_below")).cast("double")
    out = rows.groupBy(*by).agg(
        F.sum(pairs).alias("_pairs"),
        F.sum(F.try_divide(hits, shown) * F.col("pos")).alias("_steps"),
        F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return out.select(
        *by,
        F.when(both, F.try_divide(F.col("_pairs"), F.col("_p").cast("double") * F.col("_n"))).alias("auc_roc"),
        F.when(both, F.try_divide(F.col("_steps"), F.col("_p").cast("double"))).alias("auc_pr"))


def auc_roc(df: DataFrame, by: Sequence[str] = (), limit=HOT_ROWS) -> DataFrame:
    return areas(df, by, limit=limit).select(*by, "auc_roc")


def auc_pr(df: DataFrame, by: Sequence[str] = (), limit=HOT_ROWS) -> DataFrame:
    return areas(df, by, limit=limit).select(*by, "auc_pr")


def roc_curve(df: DataFrame, by: Sequence[str] = (), limit=HOT_ROWS) -> DataFrame:
    """False and true positive rate at every distinct score used as threshold."""
    rows = ranked_scores(df, by, limit=limit)
    return rows.select(
        *by, F.col("y_prob").alias("threshold"),
        _ratio(F.col("all_neg") - F.col("neg_below"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("all_pos") - F.col("pos_below"), F.col("all_pos")).alias("tpr"))


def pr_curve(df: DataFrame, by: Sequence[str] = (), limit=HOT_ROWS) -> DataFrame:
    """Precision and recall at every distinct score used as threshold."""
    rows = ranked_scores(df, by, limit=limit)
    hits = F.col("all_pos") - F.col("pos_below")
    return rows.select(
        *by, F.col("y_prob").alias("threshold"),
        _ratio(hits, hits + F.col("all_neg") - F.col("neg_below")).alias("precision"),
        _ratio(hits, F.col("all_pos")).alias("recall"))


def best_threshold(df: DataFrame, limit=HOT_ROWS) -> DataFrame:
    """Threshold with the highest F1, the lowest one on a tie; 0.5 when there is no score."""
    curve = pr_curve(df, limit=limit)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-9))
    best = curve.select("threshold", f1.alias("f1")).agg(
        F.max_by("threshold", F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("threshold"), F.max("f1").alias("f1"))
    return best.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def classification_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("TN", "FP", "FN", "TP"))
    def line(name, p, r, f, support):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), support.alias("support"))

    one = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    zero = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn), tn + fp)
    both = zero[3] + one[3]
    macro = [(a + b) / F.lit(2.0) for a, b in zip(zero[:3], one[:3])]
    weighted = [_ratio(a * zero[3] + b * one[3], both) for a, b in zip(zero[:3], one[:3])]
    lines = F.array(
        line("0", *zero), line("1", *one), line("macro avg", *macro, both), line("weighted avg", *weighted, both))
    return confusion(df, by).select(*by, F.explode(lines).alias("_line")).select(*by, "_line.*")


def confusion_share(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cells = ("TN", "FP", "FN", "TP")
    total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    return confusion(df, by).select(*by, *[_ratio(F.col(c), total).alias(c) for c in cells])


def evaluate(df: DataFrame, by: Sequence[str] = ("split",), threshold: float | None = None, limit=HOT_ROWS) -> DataFrame:
    """All metrics per group (train and test) at a threshold."""
    from editwarden.operators.rows import flag
    rows = flag(df, threshold)
    if not by:
        return evaluate(rows.withColumn("_all", F.lit(1)), ["_all"], threshold, limit).drop("_all")
    return _with_areas(binary_metrics(rows, by), areas(rows, by, limit=limit), by)


def _with_areas(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    same = [left[c].eqNullSafe(right[c]) for c in by]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return left.join(right, on).select(left["*"], right["auc_roc"], right["auc_pr"])


def compare_models(df: DataFrame, models: Mapping[str, tuple[str, str]], truth: str = "y_true", limit=HOT_ROWS) -> DataFrame:
    """All metrics of several models scored on the same rows: name -> (prediction, probability)."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(pred).alias("y_pred"), F.col(prob).alias("y_prob"))
        for name, (pred, prob) in models.items()
    ])
    long = df.select(F.col(truth).alias("y_true"), F.explode(entries).alias("_m")).select("y_true", "_m.*")
    return _with_areas(binary_metrics(long, ["model"]), areas(long, ["model"], limit=limit), ["model"])


def regional_report(df: DataFrame, regions: str, limit=HOT_ROWS) -> DataFrame:
    """Counts and metrics per region of rows that may lie in several; null areas for one class."""
    from editwarden.operators.joins import by_region
    rows = by_region(df.select("y_true", "y_pred", "y_prob", regions), regions, "region")
    report = _with_areas(binary_metrics(rows, ["region"]), areas(rows, ["region"], limit=limit), ["region"])
    correct = F.col("TP") + F.col("TN")
    total = correct + F.col("FP") + F.col("FN")
    return report.select(
        "region", total.alias("total"), correct.alias("correct"), (total - correct).alias("incorrect"),
        "TP", "TN", "FP", "FN", *METRICS, "auc_roc", "auc_pr")
