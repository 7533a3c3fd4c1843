"""Further analyses D1-D13."""

from pyspark.sql import functions as F

from checks.aggregates import rounded
from checks.features import HAS
from checks.fixtures import CHANGESETS, EDITS, changesets, edits, with_
from checks.registry import check
from editwarden.operators import insights as D
from editwarden.operators.aggregates import monthly_counts

E = with_(EDITS)


def cell(size):
    return f"trunc((centroid_x + 180) / {size}::DOUBLE)::BIGINT || '_' || trunc((centroid_y + 90) / {size}::DOUBLE)::BIGINT"


@check("D1_cell_rates", E + f"SELECT {cell(5.0)} AS cell, count(*) AS edits, round(avg(vandalism), 6) AS rate FROM edits GROUP BY 1")
def _(spark, sf):
    return rounded(D.cell_rates(edits(spark, sf), 5.0), "rate")


@check("D2_rate_encode", E + f"""
, c AS (SELECT *, {cell(10.0)} AS cell FROM edits), train AS (SELECT * FROM c WHERE year(valid_from) < 1996)
SELECT ck, round(coalesce(r, (SELECT avg(vandalism) FROM train)), 6) AS cell_rate
FROM c LEFT JOIN (SELECT cell, avg(vandalism) AS r FROM train GROUP BY 1) USING (cell)""")
def _(spark, sf):
    df = D.grid_cells(edits(spark, sf), [10.0]).withColumnRenamed("cell_10_0", "cell")
    return rounded(D.rate_encode(df, df.where(F.year("valid_from") < 1996), "cell").select("ck", "cell_rate"), "cell_rate")


@check("D3_grid_cells", E + f"SELECT ck, {cell(0.1)} AS cell_0_1, {cell(1.0)} AS cell_1_0, {cell(10.0)} AS cell_10_0 FROM edits")
def _(spark, sf):
    return D.grid_cells(edits(spark, sf), [0.1, 1.0, 10.0]).select("ck", "cell_0_1", "cell_1_0", "cell_10_0")


@check("D4_rare_tags", E + ", used AS (" + " UNION ALL ".join(
    f"SELECT ck, '{t}' AS tag FROM edits WHERE {c}" for t, c in HAS.items()) + """)
SELECT ck, count(*) AS rare_tags FROM used WHERE tag IN (SELECT tag FROM used GROUP BY 1 HAVING count(*) < 45000) GROUP BY 1""")
def _(spark, sf):
    return D.rare_tags(edits(spark, sf), 45_000)


@check("D5_revert_counts", with_(EDITS, CHANGESETS) + r"""
SELECT regexp_extract(comment, '\b(\d{6,})\b', 1)::BIGINT AS changeset_id, count(*) AS reverts FROM changesets0
WHERE regexp_matches(comment, 'vandalism|revert', 'i') AND regexp_matches(comment, '\b\d{6,}\b') GROUP BY 1""")
def _(spark, sf):
    return D.revert_counts(changesets(spark, sf))


@check("D6_neighbour_z", E + f"""
SELECT ck, round(CASE WHEN d > 0 THEN (area_delta - m) / d ELSE 0 END, 6) AS area_delta_z
FROM (SELECT ck, area_delta, avg(area_delta) OVER w AS m, stddev_pop(area_delta) OVER w AS d FROM edits WINDOW w AS (PARTITION BY {cell(10.0)}))""")
def _(spark, sf):
    return rounded(D.neighbour_z(edits(spark, sf), 10.0).select("ck", "area_delta_z"), "area_delta_z")


@check("D7_new_region", E + """
SELECT ck, max(f)::INTEGER AS new_region FROM (SELECT ck, (row_number() OVER (PARTITION BY user_id, c ORDER BY valid_from, ck) = 1)::INTEGER AS f
  FROM (SELECT ck, user_id, valid_from, unnest(countries) AS c FROM edits)) GROUP BY 1""")
def _(spark, sf):
    return D.new_region(edits(spark, sf, place=True)).select("ck", "new_region")


@check("D8_relative_length_change", E + """
SELECT ck, round(least(greatest(CASE WHEN length - length_delta > 0 THEN length_delta::DOUBLE / (length - length_delta)
  ELSE length_delta::DOUBLE END, -10), 10), 6) AS relative_length_change FROM edits""")
def _(spark, sf):
    change = D.relative_length_change(F.col("length_delta"), F.col("length"))
    return edits(spark, sf).select("ck", F.round(change, 6).alias("relative_length_change"))


@check("D9_user_profile", E + ", used AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{t}' AS tag FROM edits WHERE {c}" for t, c in HAS.items()) + """),
top AS (SELECT user_id, string_agg(tag, ',' ORDER BY r) AS top_tags FROM (
  SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, tag) AS r FROM used GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
SELECT user_id, count(*) AS edits, count(*) FILTER (contrib_type = 'CREATION') AS creates,
  count(*) FILTER (contrib_type IN ('TAG', 'GEOMETRY')) AS modifies, count(*) FILTER (contrib_type = 'DELETION') AS deletes,
  count(DISTINCT date_trunc('week', valid_from)) AS active_weeks, any_value(top_tags) AS top_tags FROM edits JOIN top USING (user_id) GROUP BY 1""")
def _(spark, sf):
    return D.user_profile(edits(spark, sf, user=True))


@check("D10_month_spikes", E + """
, m AS (SELECT month, count(*) AS n FROM edits GROUP BY 1)
SELECT month, n, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z,
  (abs((n - avg(n) OVER ()) / stddev_pop(n) OVER ()) > 2)::INTEGER AS spike FROM m""")
def _(spark, sf):
    return rounded(D.month_spikes(monthly_counts(edits(spark, sf), "valid_from"), 2.0), "z")


@check("D11_scale_interact", E + """
SELECT ck, round((area - avg(area) OVER ()) / stddev_samp(area) OVER (), 6) AS area_scaled, area * length AS area_x_length FROM edits""")
def _(spark, sf):
    df = D.interact(D.scale(edits(spark, sf), ["area"]), [("area", "length")])
    return rounded(df.select("ck", "area_scaled", "area_x_length"), "area_scaled")


@check("D12_changeset_outliers", E + """
, n AS (SELECT changeset_id, count(*) AS n FROM edits GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM n)
SELECT changeset_id, n.n FROM n, q WHERE n.n < a - 1.5 * (b - a) OR n.n > b + 1.5 * (b - a)""")
def _(spark, sf):
    return D.changeset_outliers(edits(spark, sf))


@check("D13_binned_mean", E + """
, w AS (SELECT min(length_delta)::DOUBLE AS lo, (max(length_delta) - min(length_delta)) / 10.0::DOUBLE AS d FROM edits)
SELECT least(floor((length_delta - lo) / d), 9)::BIGINT AS bin, count(*) AS n, round(avg(predicted_prob), 6) AS mean,
  round((SELECT corr(length_delta, predicted_prob) FROM edits), 6) AS corr FROM edits, w GROUP BY 1""")
def _(spark, sf):
    return rounded(D.binned_mean(edits(spark, sf), "length_delta", "predicted_prob"), "mean", "corr")
