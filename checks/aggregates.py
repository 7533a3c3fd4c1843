"""Aggregations A1-A16, top-k and order T1-T3."""

from pyspark.sql import functions as F

from checks.fixtures import EDITS, EVALUATIONS, LABELS, changeset_labels, edits, evaluations, table, with_
from checks.joins import SPLITS, split_ids
from checks.registry import check
from editwarden.operators import aggregates as A
from editwarden.operators import sampling as L
from editwarden.operators.rows import flag, with_month

E = with_(EDITS)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@check("A1_class_counts", E + "SELECT vandalism, count(*) AS n FROM edits GROUP BY 1")
def _(spark, sf):
    return A.class_counts(edits(spark, sf))


def split_edits(spark, sf):
    return edits(spark, sf).join(split_ids(spark, sf), "changeset_id")


@check("A2_split_stats", with_(EDITS, SPLITS) + """
SELECT split, count(*) AS total, sum(vandalism)::BIGINT AS vandalism, (count(*) - sum(vandalism))::BIGINT AS non_vandalism,
  round(avg(vandalism), 6) AS ratio FROM edits JOIN split_ids USING (changeset_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(A.split_stats(split_edits(spark, sf), "vandalism"), "ratio")


@check("A3_split_shapes", with_(EDITS, SPLITS) + """
SELECT split, count(*) AS rows, 3::BIGINT AS columns FROM edits JOIN split_ids USING (changeset_id) GROUP BY 1""")
def _(spark, sf):
    return A.split_shapes(split_edits(spark, sf), ["area", "length", "osm_version"])


PROFILE = """
m AS (SELECT changeset_id, predicted_prob AS p, avg(predicted_prob) OVER (PARTITION BY changeset_id) AS a FROM edits)
SELECT changeset_id, count(*) AS num_contributions, round(avg(p), 9) AS mean_prediction, round(median(p), 9) AS median_prediction,
  round(coalesce(stddev_samp(p), 0), 9) AS std_prediction, min(p) AS min_prediction, max(p) AS max_prediction,
  round(quantile_cont(p, 0.25), 9) AS quantile_25, round(quantile_cont(p, 0.75), 9) AS quantile_75,
  round(CASE WHEN min(p) = max(p) THEN 0 ELSE avg((p - a) ** 3) / avg((p - a) ** 2) ** 1.5 END, 6) AS skewness_prediction,
  round(CASE WHEN min(p) = max(p) THEN 0 ELSE avg((p - a) ** 4) / avg((p - a) ** 2) ** 2 - 3 END, 6) AS kurtosis_prediction,
  round(avg((p > 0.5)::BIGINT), 9) AS proportion_vandalism, count(*) FILTER (p > 0.5) AS num_vandalism_predictions,
  bool_or(p > 0.5)::INTEGER AS any_vandalism_prediction, bool_and(p > 0.5)::INTEGER AS all_vandalism_predictions FROM m GROUP BY 1"""


@check("A4_score_profile", with_(EDITS) + "," + PROFILE)
def _(spark, sf):
    # nine places: no mean of up to 16 four-place scores lies on a rounding edge
    nine = ("mean_prediction", "median_prediction", "std_prediction", "quantile_25", "quantile_75", "proportion_vandalism")
    df = A.score_profile(edits(spark, sf)).withColumns({n: F.round(n, 9) for n in nine})
    return rounded(df, "skewness_prediction", "kurtosis_prediction")


@check("A6_edits_per_changeset", E + "SELECT changeset_id, count(*) AS n FROM edits GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100")
def _(spark, sf):
    return A.edits_per_changeset(edits(spark, sf), top=100)


@check("A7_describe_counts", E + """
SELECT round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, round(stddev_samp(n), 6) AS std, max(n) AS max, min(n) AS min,
  quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.75) AS q75 FROM (SELECT count(*) AS n FROM edits GROUP BY changeset_id)""")
def _(spark, sf):
    return rounded(A.describe_counts(edits(spark, sf)), "mean", "std")


@check("A8_histogram", E + """
SELECT least(floor(n / 0.5), 99)::BIGINT AS bin, count(*) AS n FROM (SELECT count(*) AS n FROM edits GROUP BY changeset_id)
WHERE n BETWEEN 0 AND 50 GROUP BY 1""")
def _(spark, sf):
    return A.histogram(A.edits_per_changeset(edits(spark, sf)), "n", 100, 0, 50)


@check("A9_changeset_labels", E + """
SELECT changeset_id, count(DISTINCT vandalism) AS n_labels, CASE WHEN max(vandalism) = 1 THEN 'yes' ELSE 'no' END AS vandalism
FROM edits GROUP BY 1""")
def _(spark, sf):
    return A.changeset_labels(edits(spark, sf))


@check("A9_mixed_changesets", E + """
SELECT changeset_id, 2::BIGINT AS n_labels, 'yes' AS vandalism FROM edits GROUP BY 1 HAVING count(DISTINCT vandalism) > 1""")
def _(spark, sf):
    return A.mixed_changesets(edits(spark, sf))


@check("A9_label_totals", E + """
SELECT CASE WHEN v = 1 THEN 'yes' ELSE 'no' END AS vandalism, count(*) AS n
FROM (SELECT max(vandalism) AS v FROM edits GROUP BY changeset_id) GROUP BY 1""")
def _(spark, sf):
    return A.label_totals(A.changeset_labels(edits(spark, sf)))


@check("A10_monthly_counts", E + "SELECT month, count(*) AS n FROM edits WHERE predicted_prob >= 0.5 GROUP BY 1")
def _(spark, sf):
    return A.monthly_counts(edits(spark, sf).where("predicted_prob >= 0.5"), "valid_from")


@check("A11_monthly_summary", E + """
SELECT month, count(*) AS total_entries, count(*) FILTER (predicted_prob >= 0.5) AS vandalism_count,
  printf('%.4f', count(*) FILTER (predicted_prob >= 0.5) * 100.0::DOUBLE / count(*)) AS vandalism_percentage FROM edits GROUP BY 1""")
def _(spark, sf):
    return A.monthly_summary(with_month(flag(edits(spark, sf), prob="predicted_prob"), "valid_from"))


@check("A12_heat_cells", E + """
SELECT month, trunc((centroid_x + 180) / 5.0::DOUBLE)::BIGINT || '_' || trunc((centroid_y + 90) / 5.0::DOUBLE)::BIGINT AS cell, count(*) AS n
FROM edits GROUP BY ALL""")
def _(spark, sf):
    return A.heat_cells(edits(spark, sf), "valid_from", 5.0)


BRAND_METRICS = {
    "weight": "sum(CASE WHEN l_quantity > 49 THEN l_linenumber ELSE 0 END)", "gain": "sum(l_quantity)", "cover": "count(*)",
    "total_gain": "sum(l_quantity * l_linenumber)", "total_cover": "sum(l_linenumber)",
}


def importance_tables(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return [
        df.groupBy(F.col("p_brand").alias("feature")).agg(F.expr(expression).cast("double").alias(name))
        for name, expression in BRAND_METRICS.items()]


BRANDS = "imp AS (SELECT p_brand AS feature, " + ", ".join(
    f"({x})::DOUBLE AS {n}" for n, x in BRAND_METRICS.items()) + " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


@check("A13_importance_report", with_(BRANDS) + """
SELECT *, row_number() OVER (ORDER BY total_gain DESC, feature)::INTEGER AS rank,
  (row_number() OVER (ORDER BY total_gain DESC, feature) <= 10)::INTEGER AS is_top,
  (gain < 0.01 * (SELECT max(gain) FROM imp) AND weight = 0)::INTEGER AS is_low FROM imp""")
def _(spark, sf):
    return A.importance_report(A.importance_table(importance_tables(spark, sf)), top=10)


@check("A14_cv_summary", E + """
SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM (SELECT avg(predicted_prob) AS s FROM edits GROUP BY l_linenumber)""")
def _(spark, sf):
    folds = edits(spark, sf).groupBy("l_linenumber").agg(F.avg("predicted_prob").alias("score"))
    return rounded(A.cv_summary(folds), "mean", "std")


@check("A15_label_coverage", with_(EDITS, LABELS) + """
SELECT count(*) AS total, count(*) FILTER (e) AS matched, count(*) FILTER (NOT e) AS unmatched,
  count(*) FILTER (NOT e AND label) AS unmatched_true, count(*) FILTER (NOT e AND NOT label) AS unmatched_false
FROM (SELECT *, changeset_id IN (SELECT changeset_id FROM edits) AS e FROM changeset_labels)""")
def _(spark, sf):
    return A.label_coverage(changeset_labels(spark, sf), edits(spark, sf))


@check("A16_box_stats", with_(EDITS, EVALUATIONS) + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{c}' AS metric, min({c})::DOUBLE AS low, round(quantile_cont({c}, 0.25), 8) AS q25, "
    f"round(quantile_cont({c}, 0.5), 8) AS median, round(quantile_cont({c}, 0.75), 8) AS q75, max({c})::DOUBLE AS high "
    f"FROM evaluations WHERE y_true = {v}" for m, v in (("harmful", 1), ("other", 0)) for c in ("y_prob_main", "y_prob_hyper")))
def _(spark, sf):
    e = evaluations(spark, sf)
    parts = {"harmful": e.where("y_true = 1"), "other": e.where("y_true = 0")}
    df = A.box_stats(parts, ["y_prob_main", "y_prob_hyper"])
    return df.withColumns({n: F.round(n, 8) for n in ("q25", "median", "q75")})


@check("T1_head", E + "SELECT ck, area FROM edits ORDER BY ck LIMIT 100")
def _(spark, sf):
    return L.head(edits(spark, sf).select("ck", "area"), 100, "ck")


@check("T2_top_k", with_(BRANDS) + "SELECT feature, total_gain FROM imp ORDER BY total_gain DESC, feature LIMIT 15")
def _(spark, sf):
    return A.top_k(A.importance_table(importance_tables(spark, sf)), "total_gain", 15, "feature").select("feature", "total_gain")


@check("T3_shuffled", E + "SELECT ck, row_number() OVER (ORDER BY md5('42|' || ck), ck) - 1 AS row FROM edits")
def _(spark, sf):
    # the numbers of the shuffled order; the order itself is what writing in that order stores
    return L.numbered(edits(spark, sf).select("ck"), "ck")
