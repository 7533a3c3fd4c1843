"""Metrics and bootstrap V1-V16."""

from pyspark.sql import functions as F

from checks.aggregates import rounded
from checks.fixtures import EDITS, EVALUATIONS, edits, evaluations, with_
from checks.joins import PLACED, SPLITS, placed, split_ids
from checks.registry import check
from editwarden.operators import bootstrap as B
from editwarden.operators import metrics as V
from editwarden.operators import regions
from editwarden.operators.rows import flag

SCORED = "scored AS (SELECT *, vandalism AS y_true, predicted_prob AS y_prob, (predicted_prob >= 0.5)::INTEGER AS y_pred FROM edits)"
CELLS = """count(*) FILTER (y_true = 0 AND y_pred = 0) AS "TN", count(*) FILTER (y_true = 0 AND y_pred = 1) AS "FP",
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS "FN", count(*) FILTER (y_true = 1 AND y_pred = 1) AS "TP" """
RATES = """round(coalesce(("TP" + "TN") / nullif("TP" + "TN" + "FP" + "FN", 0), 0), 6) AS accuracy, round(coalesce("TP" / nullif("TP" + "FP", 0), 0), 6) AS precision,
  round(coalesce("TP" / nullif("TP" + "FN", 0), 0), 6) AS recall, round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 6) AS f1_score"""
S = with_(EDITS, SCORED)


def scored(spark, sf):
    df = edits(spark, sf).select("ck", "changeset_id", F.col("vandalism").alias("y_true"), F.col("predicted_prob").alias("y_prob"))
    return flag(df)


def areas_sql(source, by, weight="1"):
    """Areas by mid-ranks and by a step sum, null for one class."""
    part = f"PARTITION BY {by}"
    return f"""
g AS (SELECT {by}, y_prob, sum(CASE y_true WHEN 1 THEN {weight} ELSE 0 END)::DOUBLE AS p, sum(CASE y_true WHEN 0 THEN {weight} ELSE 0 END)::DOUBLE AS n FROM {source} GROUP BY ALL),
c AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p + n) OVER u - (p + n) / 2 + 0.5 AS midrank, sum(p) OVER w AS ap, sum(n) OVER w AS an
  FROM g WINDOW d AS ({part} ORDER BY y_prob DESC), u AS ({part} ORDER BY y_prob), w AS ({part})),
areas AS (SELECT {by}, CASE WHEN max(ap) > 0 AND max(an) > 0 THEN round((sum(p * midrank) - max(ap) * (max(ap) + 1) / 2) / (max(ap) * max(an)), 6) END AS auc_roc,
  CASE WHEN max(ap) > 0 AND max(an) > 0 THEN round(sum(p * tp / (tp + fp)) / max(ap), 6) END AS auc_pr FROM c GROUP BY 1)
"""


@check("V1_confusion", S + f"SELECT {CELLS} FROM scored")
def _(spark, sf):
    return V.confusion(scored(spark, sf))


@check("V2_binary_metrics", S + f'SELECT osm_type, "TN", "FP", "FN", "TP", {RATES} FROM (SELECT osm_type, {CELLS} FROM scored GROUP BY 1)')
def _(spark, sf):
    df = scored(spark, sf).join(edits(spark, sf).select("ck", "osm_type"), "ck")
    return rounded(V.binary_metrics(df, ["osm_type"]), *V.METRICS)


@check("V3_auc_roc", with_(EDITS, SCORED, "one AS (SELECT 1 AS k, * FROM scored)", areas_sql("one", "k")) + "SELECT auc_roc FROM areas")
def _(spark, sf):
    return rounded(V.auc_roc(scored(spark, sf)), "auc_roc")


@check("V4_auc_pr", with_(EDITS, SCORED, "one AS (SELECT 1 AS k, * FROM scored)", areas_sql("one", "k")) + "SELECT auc_pr FROM areas")
def _(spark, sf):
    return rounded(V.auc_pr(scored(spark, sf)), "auc_pr")


CURVE = """
g AS (SELECT y_prob, sum(y_true) AS p, count(*) - sum(y_true) AS n FROM scored GROUP BY 1),
curve AS (SELECT y_prob AS threshold, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW d AS (ORDER BY y_prob DESC))
"""


@check("V5_roc_curve", with_(EDITS, SCORED, CURVE) + "SELECT threshold, round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr FROM curve")
def _(spark, sf):
    return rounded(V.roc_curve(scored(spark, sf)), "fpr", "tpr")


@check("V6_pr_curve", with_(EDITS, SCORED, CURVE) + "SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall FROM curve")
def _(spark, sf):
    return rounded(V.pr_curve(scored(spark, sf)), "precision", "recall")


@check("V7_best_threshold", with_(EDITS, SCORED, CURVE) + """
SELECT threshold, round(f1, 6) AS f1 FROM (SELECT threshold, 2 * (tp / (tp + fp)) * (tp / ap) / (tp / (tp + fp) + tp / ap + 1e-9) AS f1 FROM curve)
ORDER BY f1 DESC, threshold LIMIT 1""")
def _(spark, sf):
    return rounded(V.best_threshold(scored(spark, sf)), "f1")


@check("V8_classification_report", S + f"""
, k AS (SELECT {CELLS} FROM scored), per AS (
  SELECT '1' AS class, "TP" / ("TP" + "FP") AS precision, "TP" / ("TP" + "FN") AS recall, 2 * "TP" / (2 * "TP" + "FP" + "FN") AS f1_score, "TP" + "FN" AS support FROM k
  UNION ALL SELECT '0', "TN" / ("TN" + "FN"), "TN" / ("TN" + "FP"), 2 * "TN" / (2 * "TN" + "FP" + "FN"), "TN" + "FP" FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support::BIGINT AS support FROM (
  FROM per UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support) FROM per)""")
def _(spark, sf):
    return rounded(V.classification_report(scored(spark, sf)), "precision", "recall", "f1_score")


@check("V9_evaluate", with_(
    EDITS, SCORED, SPLITS, "parts AS (SELECT * REPLACE ((y_prob >= 0.6)::INTEGER AS y_pred) FROM scored JOIN split_ids USING (changeset_id))",
    areas_sql("parts", "split")) + f"""
SELECT split, "TN", "FP", "FN", "TP", {RATES}, auc_roc, auc_pr FROM (SELECT split, {CELLS} FROM parts GROUP BY 1) JOIN areas USING (split)""")
def _(spark, sf):
    df = scored(spark, sf).join(split_ids(spark, sf), "changeset_id")
    return rounded(V.evaluate(df, ["split"], 0.6), *V.METRICS, "auc_roc", "auc_pr")


@check("V10_regional_report", with_(
    EDITS, PLACED, "parts AS (SELECT continent AS region, vandalism AS y_true, predicted_prob AS y_prob, (predicted_prob >= 0.5)::INTEGER AS y_pred FROM placed)",
    areas_sql("parts", "region")) + f"""
SELECT region, "TP" + "TN" + "FP" + "FN" AS total, "TP" + "TN" AS correct, "FP" + "FN" AS incorrect, "TN", "FP", "FN", "TP", {RATES}, auc_roc, auc_pr
FROM (SELECT region, {CELLS} FROM parts GROUP BY 1) JOIN areas USING (region)""")
def _(spark, sf):
    df = placed(spark, sf).select("continents", F.col("vandalism").alias("y_true"), F.col("predicted_prob").alias("y_prob"))
    return rounded(V.regional_report(flag(df), "continents"), *V.METRICS, "auc_roc", "auc_pr")


@check("V10_country_report", with_(
    EDITS, "parts AS (SELECT unnest(countries) AS region, vandalism AS y_true, predicted_prob AS y_prob, (predicted_prob >= 0.5)::INTEGER AS y_pred FROM edits)",
    areas_sql("parts", "region")) + f"""
SELECT region, "TP" + "TN" + "FP" + "FN" AS total, "TP" + "TN" AS correct, "FP" + "FN" AS incorrect, "TN", "FP", "FN", "TP", {RATES}, auc_roc, auc_pr
FROM (SELECT region, {CELLS} FROM parts GROUP BY 1) JOIN areas USING (region)""")
def _(spark, sf):
    df = edits(spark, sf, place=True).select(F.col("country_iso_a3").alias("countries"), F.col("vandalism").alias("y_true"), F.col("predicted_prob").alias("y_prob"))
    return rounded(V.regional_report(flag(df), "countries"), *V.METRICS, "auc_roc", "auc_pr")


@check("V11_confusion_share", S + f"""
SELECT round("TN" / t, 6) AS "TN", round("FP" / t, 6) AS "FP", round("FN" / t, 6) AS "FN", round("TP" / t, 6) AS "TP" FROM (SELECT {CELLS}, count(*) AS t FROM scored)""")
def _(spark, sf):
    return rounded(V.confusion_share(scored(spark, sf)), "TN", "FP", "FN", "TP")


MODELS = {"main": "y_prob_main", "hyper": "y_prob_hyper", "meta": "((y_prob_main + y_prob_hyper) / 2)"}


@check("V12_compare_models", with_(EDITS, EVALUATIONS, "parts AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, y_true, {p} AS y_prob, ({p} >= 0.5)::INTEGER AS y_pred FROM evaluations" for m, p in MODELS.items()) + ")",
    areas_sql("parts", "model")) + f"""
SELECT model, "TN", "FP", "FN", "TP", {RATES}, auc_roc, auc_pr FROM (SELECT model, {CELLS} FROM parts GROUP BY 1) JOIN areas USING (model)""")
def _(spark, sf):
    df = evaluations(spark, sf).withColumn("y_prob_meta", (F.col("y_prob_main") + F.col("y_prob_hyper")) / 2)
    for m in MODELS:
        df = flag(df, 0.5, f"y_prob_{m}", f"y_pred_{m}")
    return rounded(
        V.compare_models(df, {m: (f"y_pred_{m}", f"y_prob_{m}") for m in MODELS}), *V.METRICS, "auc_roc", "auc_pr")


ITERATIONS = 20
DRAWS = f"""
numbered AS (SELECT y_true, y_prob, y_pred, row_number() OVER (ORDER BY md5('42|' || ck), ck) - 1 AS row FROM scored),
size AS (SELECT count(*) AS n FROM numbered),
hashed AS (SELECT i AS iteration, k AS pair, n, md5('42|' || i || '|' || k) AS t
  FROM (SELECT unnest(range({ITERATIONS})) AS i), (SELECT n, unnest(range((n + 1) // 2)) AS k FROM size)),
slots AS (SELECT iteration, ('0x' || substr(t, 1, 15))::BIGINT % n AS row FROM hashed
  UNION ALL SELECT iteration, ('0x' || substr(t, 17, 15))::BIGINT % n FROM hashed WHERE pair * 2 + 1 < n),
drawn AS (SELECT iteration, y_true, y_prob, y_pred FROM slots JOIN numbered USING (row))
"""
RESAMPLED = f"""
boot AS (SELECT iteration, accuracy AS "Accuracy", precision AS "Precision", recall AS "Recall", f1_score AS "F1-score", auc_roc AS "AUC-ROC", auc_pr AS "AUC-PR"
  FROM (SELECT iteration, {RATES.replace(', 6) AS', ', 9) AS')} FROM (SELECT iteration, {CELLS} FROM drawn GROUP BY 1)) JOIN areas USING (iteration))
"""
AREAS9 = areas_sql("drawn", "iteration").replace(", 6) END", ", 9) END")


def bootstrapped(spark, sf):
    df = B.bootstrap(scored(spark, sf), "ck", ITERATIONS)
    return df.withColumns({m: F.round(F.col(f"`{m}`"), 9) for m in B.METRIC_NAMES})


@check("V13_bootstrap", with_(EDITS, SCORED, DRAWS, AREAS9, RESAMPLED) + "FROM boot")
def _(spark, sf):
    return bootstrapped(spark, sf)


CUMULATIVE = []
upto, chance = 0.0, 2.718281828459045 ** -1
for k in range(18):
    upto += chance
    CUMULATIVE.append(f"(u >= {upto!r}::DOUBLE)::BIGINT")
    chance /= k + 1


@check("V13_bootstrap_poisson", with_(EDITS, SCORED, f"""
pairs AS (SELECT y_true, y_prob, y_pred, i AS iteration, ('0x' || substr(md5('42|' || i || '|' || ck), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
  FROM scored, (SELECT unnest(range({ITERATIONS})) AS i)),
drawn AS (SELECT iteration, y_true, y_prob, y_pred, unnest(range({' + '.join(CUMULATIVE)})) AS copy FROM pairs)""",
    AREAS9, RESAMPLED) + "FROM boot")
def _(spark, sf):
    df = B.bootstrap(scored(spark, sf), "ck", ITERATIONS, poisson=True)
    return df.withColumns({m: F.round(F.col(f"`{m}`"), 9) for m in B.METRIC_NAMES})


LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, \"{m}\" AS value FROM boot" for m in B.METRIC_NAMES) + ")"


@check("V14_bootstrap_summary", with_(EDITS, SCORED, DRAWS, AREAS9, RESAMPLED, LONG) + """
SELECT metric, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std_dev, round(quantile_cont(value, 0.025), 7) AS ci_lower,
  round(quantile_cont(value, 0.975), 7) AS ci_upper FROM long GROUP BY 1""")
def _(spark, sf):
    df = B.bootstrap_summary(bootstrapped(spark, sf))
    return df.withColumns({c: F.round(c, 7) for c in ("mean", "std_dev", "ci_lower", "ci_upper")})


SHAPE = """
base AS (SELECT metric, value - avg(value) OVER (PARTITION BY metric) AS d FROM long),
mo AS (SELECT metric, count(*)::DOUBLE AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS g, avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS k FROM base GROUP BY 1),
s1 AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n ** 2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (k + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
  6 * (n ** 2 - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM mo),
s2 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / b * (2 / b + sqrt(1 + 4 / b ** 2)) AS a FROM s1),
s3 AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d FROM s2),
s4 AS (SELECT *, (1 - 2 / (9 * a) - sign(d) * ((1 - 2 / a) / abs(d)) ** (1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)) AS z2 FROM s3)
"""


@check("V15_bootstrap_shape", with_(EDITS, SCORED, DRAWS, AREAS9, RESAMPLED, LONG, SHAPE) + """
SELECT metric, round(g, 5) AS skewness, round(k, 5) AS kurtosis, CASE WHEN exp(-(z1 ** 2 + z2 ** 2) / 2) > 0.05 THEN 'Yes' ELSE 'No' END AS normal,
  round(exp(-(z1 ** 2 + z2 ** 2) / 2), 5) AS p_value FROM s4""")
def _(spark, sf):
    df = B.bootstrap_shape(bootstrapped(spark, sf))
    return df.withColumns({c: F.round(c, 5) for c in ("skewness", "kurtosis", "p_value")})


@check("V16_geo_combo_report", with_(EDITS, PLACED) + f"""
, names AS (SELECT DISTINCT continent AS c FROM placed),
pick AS (SELECT list_sort([a.c, b.c]) AS g FROM names a JOIN names b ON a.c < b.c
  UNION ALL SELECT list_sort([a.c, b.c, d.c]) FROM names a JOIN names b ON a.c < b.c JOIN names d ON b.c < d.c),
triples AS (SELECT t.g AS t, v.g AS v, (SELECT list_sort(list(c)) FROM names WHERE NOT list_contains(t.g, c) AND NOT list_contains(v.g, c)) AS s
  FROM pick t JOIN pick v ON NOT list_has_any(t.g, v.g)),
sets AS (SELECT ck, list(continent) AS r, any_value(vandalism) AS y_true, any_value((predicted_prob >= 0.5)::INTEGER) AS y_pred FROM placed GROUP BY 1),
cells AS (SELECT s, {CELLS} FROM (SELECT DISTINCT s FROM triples WHERE len(s) BETWEEN 2 AND 3) LEFT JOIN sets ON list_has_any(s, r) GROUP BY 1)
SELECT array_to_string(t, ',') AS train_regions, array_to_string(v, ',') AS val_regions, array_to_string(s, ',') AS test_regions, "TN", "FP", "FN", "TP", {RATES}
FROM triples JOIN cells USING (s)""")
def _(spark, sf):
    df = placed(spark, sf).select("continents", F.col("vandalism").alias("y_true"), F.col("predicted_prob").alias("y_prob"))
    df = regions.geo_combo_report(flag(df)).drop("combination")
    names = ("train_regions", "val_regions", "test_regions")
    return rounded(df.withColumns({c: F.array_join(F.sort_array(c), ",") for c in names}), *V.METRICS)
