"""Feature expressions F1-F28."""

from pyspark.sql import functions as F

from checks.fixtures import CHANGESETS, EDITS, changesets, edits, full_changesets, table, with_
from checks.registry import check
from editwarden.functions import places, tags, texts, times
from editwarden.functions.tags import KEY_TAGS

E = with_(EDITS)
EC = with_(EDITS, CHANGESETS)

HAD = {t: f"((l_partkey + {i}) % 3 <> 0)" for i, t in enumerate(KEY_TAGS)}
HAS = {t: f"((l_suppkey + {i}) % 4 <> 0)" for i, t in enumerate(KEY_TAGS)}
SAME = {t: f"(l_partkey % {i + 2} = l_suppkey % {i + 2})" for i, t in enumerate(KEY_TAGS)}


def _total(*conditions):
    return "(" + " + ".join(f"({c})::BIGINT" for c in conditions) + ")"


ADDED = _total(*[f"{HAS[t]} AND NOT {HAD[t]}" for t in KEY_TAGS])
REMOVED = _total(*[f"{HAD[t]} AND NOT {HAS[t]}" for t in KEY_TAGS])
MODIFIED = _total(*[f"{HAD[t]} AND {HAS[t]} AND NOT {SAME[t]}" for t in KEY_TAGS])
N_TAGS = _total(*HAS.values())

CONTINENT_TEXT = (
    "coalesce(nullif(concat_ws(',', "
    + ", ".join(
        f"CASE WHEN xmax >= {w}::DOUBLE AND xmin <= {e}::DOUBLE AND ymax >= {s}::DOUBLE AND ymin <= {n}::DOUBLE THEN '{name}' END"
        for name, s, n, w, e in places.CONTINENT_BOXES)
    + "), ''), 'Other')"
)


@check("F1_geometric", E + """
SELECT ck, area_delta, length_delta, area, length, geometry_type,
  round((xmax - xmin) * (ymax - ymin), 6) AS bounding_box_size, geometry_valid::BIGINT AS geometry_valid,
  round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, round(ymin, 6) AS ymin, round(ymax, 6) AS ymax FROM edits""")
def _(spark, sf):
    from editwarden.plans.features import geometric_features
    df = geometric_features(edits(spark, sf), keep=["ck"])
    rounded = {c: F.round(c, 6) for c in ("bounding_box_size", "xmin", "xmax", "ymin", "ymax")}
    return df.withColumns(rounded | {"geometry_valid": F.col("geometry_valid").cast("bigint")})


@check("F2_time_of_day", E + """
SELECT ck, CASE WHEN hour(changeset_ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(changeset_ts) BETWEEN 12 AND 16
  THEN 'afternoon' WHEN hour(changeset_ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day FROM edits""")
def _(spark, sf):
    return edits(spark, sf, user=True).select("ck", times.time_of_day(F.col("changeset_ts")).alias("time_of_day"))


@check("F3_day_of_week", E + """
SELECT ck, (isodow(changeset_ts) - 1)::BIGINT AS day_of_week, (isodow(changeset_ts) >= 6)::BIGINT AS is_weekend,
  valid_from AS date_created FROM edits""")
def _(spark, sf):
    day = times.day_of_week(F.col("changeset_ts")).cast("bigint")
    return edits(spark, sf, user=True).select(
        "ck", day.alias("day_of_week"), (day >= 5).cast("bigint").alias("is_weekend"),
        F.col("valid_from").alias("date_created"))


@check("F4_tag_diff", E + f"""
SELECT ck, {ADDED} AS tags_added, {REMOVED} AS tags_removed, {MODIFIED} AS tags_modified,
  {ADDED} + {REMOVED} + {MODIFIED} AS tags_changed, {N_TAGS} AS total_tags FROM edits""")
def _(spark, sf):
    diff = tags.tag_diff(F.col("tags_before"), F.col("tags"))
    return edits(spark, sf).select("ck", *[c.cast("bigint").alias(n) for n, c in diff.items()])


@check("F5_key_tag_flags", E + "SELECT ck, " + ", ".join(
    f"({HAS[t]} AND NOT {HAD[t]})::BIGINT AS {t}_added, ({HAD[t]} AND NOT {HAS[t]})::BIGINT AS {t}_removed, "
    f"({HAD[t]} AND {HAS[t]} AND NOT {SAME[t]})::BIGINT AS {t}_modified, "
    f"(({HAS[t]} <> {HAD[t]}) OR ({HAS[t]} AND {HAD[t]} AND NOT {SAME[t]}))::BIGINT AS {t}_changed"
    for t in KEY_TAGS) + " FROM edits")
def _(spark, sf):
    flags = tags.key_tag_flags(F.col("tags_before"), F.col("tags"))
    return edits(spark, sf).select("ck", *[c.cast("bigint").alias(n) for n, c in flags.items()])


@check("F6_content_columns", E + """
SELECT ck, osm_type, osm_id, osm_version, contrib_type AS contribution_type, '' AS members, l_linestatus AS status FROM edits""")
def _(spark, sf):
    from editwarden.plans.features import content_columns
    df = content_columns(edits(spark, sf), keep=["ck"])
    return df.withColumn("members", F.concat_ws(",", "members"))


@check("F7_spatial", E + """
SELECT ck, round(xmax - xmin, 6) AS bbox_x_range, round(ymax - ymin, 6) AS bbox_y_range,
  round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y FROM edits""")
def _(spark, sf):
    return edits(spark, sf).select(
        "ck", F.round(F.col("xmax") - F.col("xmin"), 6).alias("bbox_x_range"),
        F.round(F.col("ymax") - F.col("ymin"), 6).alias("bbox_y_range"),
        F.round("centroid.x", 6).alias("centroid_x"), F.round("centroid.y", 6).alias("centroid_y"))


@check("F8_grid_cell", E + "SELECT ck, grid_cell_id FROM edits")
def _(spark, sf):
    return edits(spark, sf).select("ck", places.grid_cell(F.col("centroid_x"), F.col("centroid_y")).alias("grid_cell_id"))


@check("F9_continents", E + f"SELECT ck, {CONTINENT_TEXT} AS continents FROM edits")
def _(spark, sf):
    found = places.continents(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    return edits(spark, sf).select("ck", F.concat_ws(",", found).alias("continents"))


@check("F10_countries", E + "SELECT ck, len(countries)::BIGINT AS country_count, array_to_string(countries, ',') AS countries FROM edits")
def _(spark, sf):
    return edits(spark, sf, place=True).select(
        "ck", F.size("country_iso_a3").cast("bigint").alias("country_count"), F.concat_ws(",", "country_iso_a3").alias("countries"))


@check("F11_tag_density", E + f"""
SELECT ck, round(CASE WHEN area > 0 THEN least(ln(1 + {N_TAGS} / area::DOUBLE), 10) ELSE 0 END, 6) AS tag_density FROM edits""")
def _(spark, sf):
    return edits(spark, sf).select("ck", F.round(tags.tag_density(F.size("tags"), F.col("area")), 6).alias("tag_density"))


@check("F12_relative_area_change", E + """
SELECT ck, round(least(greatest(CASE WHEN area - area_delta > 0 THEN area_delta::DOUBLE / (area - area_delta)
  ELSE area_delta::DOUBLE END, -10), 10), 6) AS relative_area_change FROM edits""")
def _(spark, sf):
    change = places.relative_change(F.col("area_delta"), F.col("area"))
    return edits(spark, sf).select("ck", F.round(change, 6).alias("relative_area_change"))


@check("F13_comment_length", EC + """
SELECT ck, length(coalesce(comment, ''))::BIGINT AS changeset_comment_length FROM edits JOIN changesets0 USING (changeset_id)""")
def _(spark, sf):
    length = tags.comment_length(F.col("changeset.tags"))
    return edits(spark, sf, comment=True).select("ck", length.cast("bigint").alias("changeset_comment_length"))


@check("F14_source", EC + """
SELECT ck, (coalesce(source, '') <> 'survey' AND source IS NOT NULL)::BIGINT AS source_reliability,
  coalesce(source, 'unknown') AS source_used FROM edits JOIN changesets0 USING (changeset_id)""")
def _(spark, sf):
    found = tags.source_features(F.col("changeset.tags"))
    return edits(spark, sf, comment=True).select(
        "ck", found["source_reliability"].cast("bigint").alias("source_reliability"), found["source_used"].alias("source_used"))


@check("F15_edit_key", E + """
SELECT ck, strftime(valid_from, '%Y-%m-%d %H:%M:%S') || '__' || osm_id || '__' || osm_version AS contribution_key, changeset_id
FROM edits""")
def _(spark, sf):
    from editwarden.plans.features import edit_key
    return edits(spark, sf).select("ck", edit_key().alias("contribution_key"), "changeset_id")


@check("F16_map_features", E + """
SELECT ck, (h % 2 = 0)::BIGINT AS building, (h % 5 <> 0 AND h % 3 = 0)::BIGINT AS highway, (h % 7 = 0)::BIGINT AS landuse FROM edits""")
def _(spark, sf):
    from editwarden.plans.features import map_feature_flags
    df = edits(spark, sf)
    return df.select("ck", *[c.cast("bigint").alias(n) for n, c in map_feature_flags(df).items()])


@check("F17_element_columns", E + """
SELECT ck, count(*) OVER (PARTITION BY osm_id ORDER BY valid_from, ck ROWS UNBOUNDED PRECEDING) AS element_n_versions,
  lag(valid_from) OVER (PARTITION BY osm_id ORDER BY valid_from, ck) AS element_previous_edit_timestamp,
  sum(f) OVER (PARTITION BY osm_id ORDER BY valid_from, ck ROWS UNBOUNDED PRECEDING)::BIGINT AS element_n_users_cum,
  coalesce(date_diff('second', lag(valid_from) OVER (PARTITION BY osm_id ORDER BY valid_from, ck), valid_from), -1)::DOUBLE
    AS element_time_since_previous_edit
FROM (SELECT *, (row_number() OVER (PARTITION BY osm_id, user_id ORDER BY valid_from, ck) = 1)::BIGINT AS f FROM edits)""")
def _(spark, sf):
    from editwarden.operators.history import element_history
    from editwarden.plans.features import element_columns
    df = element_history(edits(spark, sf, user=True)).withColumnRenamed(
        "element_previous_edit_timestamp", "element_previous_edit_valid")
    return df.select("ck", *[c.alias(n) for n, c in element_columns(df).items()])


@check("F18_user_columns", E + """
SELECT ck, count(*) OVER (PARTITION BY user_id) AS n_edits,
  sum(fc) OVER w::BIGINT AS user_n_changesets_cum, count(*) OVER w AS user_n_edits_cum, sum(fd) OVER w::BIGINT AS user_n_edit_days_cum,
  lag(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from, ck) AS user_previous_edit_timestamp,
  coalesce(date_diff('second', lag(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from, ck), valid_from), -1)::DOUBLE
    AS user_time_since_previous_edit
FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, changeset_id ORDER BY valid_from, ck) = 1)::BIGINT AS fc,
  (row_number() OVER (PARTITION BY user_id, valid_from::DATE ORDER BY valid_from, ck) = 1)::BIGINT AS fd FROM edits)
WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, ck ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    from editwarden.operators.history import user_history
    from editwarden.plans.features import USER_COLUMNS
    return user_history(edits(spark, sf, user=True)).select("ck", *USER_COLUMNS)


@check("F20_changeset_features", EC + """
SELECT changeset_id, round(coalesce(min_lon, 0), 6) AS min_lon, round(coalesce(max_lon, 0), 6) AS max_lon,
  round(coalesce(min_lat, 0), 6) AS min_lat, round(coalesce(max_lat, 0), 6) AS max_lat,
  round((coalesce(min_lon, 0) + coalesce(max_lon, 0)) / 2, 6) AS centroid_x,
  round((coalesce(min_lat, 0) + coalesce(max_lat, 0)) / 2, 6) AS centroid_y,
  length(coalesce(comment, ''))::BIGINT AS changeset_comment_length, created_at AS date_created FROM changesets""")
def _(spark, sf):
    from editwarden.plans.features import changeset_features
    df = changeset_features(full_changesets(spark, sf), temporal=True)
    numbers = ("min_lon", "max_lon", "min_lat", "max_lat", "centroid_x", "centroid_y")
    return df.select("changeset_id", *[F.round(c, 6).alias(c) for c in numbers],
                     F.col("changeset_comment_length").cast("bigint"), "date_created")


@check("F21_text_timestamp", E + """
SELECT ck, CASE WHEN h % 17 = 0 OR h % 19 = 0 THEN -1 ELSE epoch(date_trunc('minute', valid_from)) END::DOUBLE AS previous_edit FROM edits""")
def _(spark, sf):
    return edits(spark, sf).select("ck", times.text_to_epoch(F.col("previous_text")).alias("previous_edit"))


@check("F22_epoch", EC + """
SELECT changeset_id, epoch(closed_at)::DOUBLE AS closed_at, epoch(account_created)::DOUBLE AS account_created FROM changesets0""")
def _(spark, sf):
    return changesets(spark, sf).select("changeset_id", *[
        times.epoch_seconds(F.col(c)).alias(c) for c in ("closed_at", "account_created")])


@check("F23_interval", E + """
SELECT ck, ((h % 3) * 2592000 + (h % 28) * 86400 + (h % 1000))::DOUBLE AS seconds FROM edits""")
def _(spark, sf):
    return edits(spark, sf).select("ck", times.interval_seconds(F.col("interval")).alias("seconds"))


@check("F24_mine_reverts", EC + r"""
SELECT changeset_id, comment, nullif(regexp_extract(comment, '\b(\d{6,})\b', 1), '') AS original_changeset_id, 'vandalism' AS label
FROM changesets0 WHERE regexp_matches(comment, 'vandalism|revert', 'i')""")
def _(spark, sf):
    from editwarden.operators.rows import mine_reverts
    return mine_reverts(changesets(spark, sf))


@check("F25_osmchange_counts", E + """
SELECT changeset_id, count(*) FILTER (osm_type = 'node') AS no_nodes, count(*) FILTER (osm_type = 'way') AS no_ways,
  count(*) FILTER (osm_type = 'relation') AS no_relations, count(*) FILTER (contrib_type = 'CREATION') AS no_creates,
  count(*) FILTER (contrib_type IN ('TAG', 'GEOMETRY')) AS no_modifications, count(*) FILTER (contrib_type = 'DELETION') AS no_deletions
FROM edits GROUP BY 1""")
def _(spark, sf):
    # one osmChange document per edit
    action = F.when(F.col("contrib_type") == "CREATION", "create").when(
        F.col("contrib_type") == "DELETION", "delete").otherwise("modify")
    xml = F.concat(F.lit("<osmChange><"), action, F.lit("><"), F.col("osm_type"), F.lit(' id="'), F.col("osm_id"),
                   F.lit('"/></'), action, F.lit("></osmChange>"))
    counts = texts.osmchange_counts(xml)
    rows = edits(spark, sf).select("changeset_id", *[c.alias(n) for n, c in counts.items()])
    return rows.groupBy("changeset_id").agg(*[F.sum(n).alias(n) for n in counts])


@check("F26_user_info", """
SELECT c_custkey AS user_id, TIMESTAMP '2010-01-01' + to_days((c_custkey % 3000)::INTEGER) AS account_created,
  (c_custkey % 977)::BIGINT AS changes_count FROM customer""")
def _(spark, sf):
    day = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")), "yyyy-MM-dd")
    xml = F.concat(
        F.lit('<osm><user id="'), F.col("c_custkey"), F.lit('" account_created="'), day,
        F.lit('T00:00:00"><changesets count="'), F.col("c_custkey") % 977, F.lit('"/></user></osm>'))
    found = texts.user_info(xml)
    # narrow rows and much work on each: dealt out to all cores, however few splits the scan has
    rows = table(spark, sf, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select(
        F.col("c_custkey").alias("user_id"), found["account_created"].alias("account_created"),
        found["changes_count"].cast("bigint").alias("changes_count"))


@check("F27_month_label", E + "SELECT ck, month, month AS month_from_name FROM edits")
def _(spark, sf):
    month = times.month_label(F.col("valid_from"))
    name = F.concat(F.lit("edits_"), month, F.lit("-01.parquet"))
    return edits(spark, sf).select("ck", month.alias("month"), times.month_from_name(name).alias("month_from_name"))


@check("F28_percentage", E + """
SELECT month, printf('%.4f', sum(vandalism) * 100.0::DOUBLE / count(*)) AS percentage, '0.0000' AS empty FROM edits GROUP BY 1""")
def _(spark, sf):
    return edits(spark, sf).groupBy(times.month_label(F.col("valid_from")).alias("month")).agg(
        texts.percentage_text(F.sum("vandalism"), F.count(F.lit(1))).alias("percentage"),
        texts.percentage_text(F.sum(F.lit(0)), F.sum(F.lit(0))).alias("empty"))
