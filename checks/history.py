"""History of users and elements W1-W10."""

from pyspark.sql import functions as F

from checks.fixtures import EDITS, edits, with_
from checks.registry import check
from editwarden.operators import history as H

E = with_(EDITS)


def by_user(spark, sf):
    return edits(spark, sf, user=True)


@check("W1_user_total", E + "SELECT ck, count(*) OVER (PARTITION BY user_id) AS n_edits FROM edits")
def _(spark, sf):
    return H.user_total(by_user(spark, sf)).select("ck", "n_edits")


@check("W2_user_edits_cum", E + """
SELECT ck, row_number() OVER (PARTITION BY user_id ORDER BY valid_from, ck) AS user_n_edits_cum FROM edits""")
def _(spark, sf):
    return H.user_edits_cum(by_user(spark, sf)).select("ck", F.col("user_n_edits_cum").cast("bigint"))


@check("W3_user_distinct_cum", E + """
SELECT ck, sum(fc) OVER w::BIGINT AS user_n_changesets_cum, sum(fd) OVER w::BIGINT AS user_n_edit_days_cum
FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, changeset_id ORDER BY valid_from, ck) = 1)::BIGINT AS fc,
  (row_number() OVER (PARTITION BY user_id, valid_from::DATE ORDER BY valid_from, ck) = 1)::BIGINT AS fd FROM edits)
WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, ck ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return H.user_distinct_cum(by_user(spark, sf)).select("ck", "user_n_changesets_cum", "user_n_edit_days_cum")


@check("W4_user_recency", E + """
SELECT ck, lag(valid_from) OVER w AS user_previous_edit_timestamp,
  coalesce(date_diff('second', lag(valid_from) OVER w, valid_from), -1)::DOUBLE AS user_time_since_previous_edit
FROM edits WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, ck)""")
def _(spark, sf):
    return H.user_recency(by_user(spark, sf)).select("ck", "user_previous_edit_timestamp", "user_time_since_previous_edit")


@check("W5_element_cum", E + """
SELECT ck, count(*) OVER w AS element_n_versions, sum(f) OVER w::BIGINT AS element_n_users_cum
FROM (SELECT *, (row_number() OVER (PARTITION BY osm_id, user_id ORDER BY valid_from, ck) = 1)::BIGINT AS f FROM edits)
WINDOW w AS (PARTITION BY osm_id ORDER BY valid_from, ck ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return H.element_cum(by_user(spark, sf)).select("ck", F.col("element_n_versions").cast("bigint"), "element_n_users_cum")


@check("W6_element_recency", E + """
SELECT ck, lag(valid_from) OVER w AS element_previous_edit_timestamp,
  coalesce(date_diff('second', lag(valid_from) OVER w, valid_from), -1)::DOUBLE AS element_time_since_previous_edit
FROM edits WINDOW w AS (PARTITION BY osm_id ORDER BY valid_from, ck)""")
def _(spark, sf):
    return H.element_recency(edits(spark, sf)).select(
        "ck", "element_previous_edit_timestamp", "element_time_since_previous_edit")


@check("W7_user_rate", E + """
SELECT ck, count(*) OVER (PARTITION BY user_id ORDER BY valid_from RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)
  AS user_edits_30d FROM edits""")
def _(spark, sf):
    return H.user_rate(by_user(spark, sf), 30).select("ck", "user_edits_30d")


@check("W8_user_mean_size", E + """
SELECT ck, round(avg(area_delta) OVER w, 6) AS user_mean_area_delta, round(avg(length_delta) OVER w, 6) AS user_mean_length_delta
FROM edits WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, ck ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    names = ("user_mean_area_delta", "user_mean_length_delta")
    return H.user_mean_size(by_user(spark, sf)).select("ck", *[F.round(n, 6).alias(n) for n in names])


@check("W9_edit_duration", E + """
SELECT ck, date_diff('second', valid_from, coalesce(valid_to, lead(valid_from) OVER (PARTITION BY osm_id ORDER BY valid_from, ck)))::DOUBLE
  AS edit_duration FROM edits""")
def _(spark, sf):
    return H.edit_duration(edits(spark, sf)).select("ck", "edit_duration")


@check("W10_element_churn", E + """
SELECT ck, count(*) OVER (PARTITION BY osm_id ORDER BY valid_from RANGE BETWEEN INTERVAL 720 HOUR PRECEDING AND CURRENT ROW)
  AS element_edits_720h FROM edits""")
def _(spark, sf):
    return H.element_churn(edits(spark, sf), 720).select("ck", "element_edits_720h")
