"""Projections, filters and predicates P1-P17."""

from pyspark.sql import functions as F

from checks.fixtures import CHANGESETS, EDITS, IDS, LABELS, changeset_labels, changesets, edits, id_list, with_
from checks.registry import check
from editwarden.functions import texts
from editwarden.operators import rows as R
from editwarden.operators.sampling import group_split

E = with_(EDITS)
EC = with_(EDITS, CHANGESETS)


@check("P1_normalize_label", E + "SELECT ck, vandalism::INTEGER AS vandalism FROM edits")
def _(spark, sf):
    df = edits(spark, sf).select("ck", (F.col("vandalism") == 1).alias("vandalism"))
    return R.normalize_label(df, "vandalism")


@check("P2_yes_no", E + """
SELECT ck, CASE h % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' WHEN 4 THEN 'no' END AS label FROM edits""")
def _(spark, sf):
    spellings = F.array(*[F.lit(v) for v in ("yes", "TRUE", "true", "no", "FALSE", "maybe", None)])
    raw = F.element_at(spellings, (F.col("h") % 7 + 1).cast("int"))
    return edits(spark, sf).select("ck", texts.yes_no(raw).alias("label"))


@check("P3_restrict_to_ids", with_(EDITS, IDS) + "SELECT ck, changeset_id FROM edits WHERE changeset_id IN (FROM id_list)")
def _(spark, sf):
    return R.restrict_to_ids(edits(spark, sf), id_list(spark, sf)).select("ck", "changeset_id")


@check("P4_label_edits", with_(EDITS, LABELS) + """
SELECT ck, changeset_id, label::VARCHAR AS vandalism FROM edits JOIN changeset_labels USING (changeset_id)""")
def _(spark, sf):
    df = edits(spark, sf).select("ck", F.struct(F.col("changeset_id").alias("id")).alias("changeset"))
    labels = changeset_labels(spark, sf).withColumnRenamed("label", "vandalism")
    return R.label_edits(df, labels).select("ck", F.col("changeset.id").alias("changeset_id"), "vandalism")


@check("P5_drop_existing", E + "SELECT ck, area, length FROM edits")
def _(spark, sf):
    df = edits(spark, sf).select("ck", "area", "length", "osm_id", "members", "status", "geometry")
    return R.drop_existing(df, R.EDIT_DROPS)


@check("P6_snake_columns", E + "SELECT ck, area AS area_in_square_metres, length AS length_in_metres FROM edits")
def _(spark, sf):
    df = edits(spark, sf).select(
        "ck", F.col("area").alias("area in square metres"), F.col("length").alias("length in metres"))
    return R.snake_columns(df)


@check("P7_unnest_xzcode", E + "SELECT ck, (h % 16)::INTEGER AS level, h % 100000 AS code FROM edits")
def _(spark, sf):
    return R.unnest_xzcode(edits(spark, sf).select("ck", "xzcode"))


@check("P8_align_columns", E + "SELECT length, 0 AS country_Nowhere, area FROM edits")
def _(spark, sf):
    return R.align_columns(edits(spark, sf).select("ck", "area", "length"), ["length", "country_Nowhere", "area"])


@check("P9_flag", E + "SELECT ck, (predicted_prob >= 0.5)::INTEGER AS y_pred FROM edits")
def _(spark, sf):
    return R.flag(edits(spark, sf), prob="predicted_prob").select("ck", "y_pred")


@check("P10_flagged", E + """
SELECT changeset_id, valid_from AS date_created, osm_id, osm_version, round(centroid_x, 6) AS centroid_x,
  round(centroid_y, 6) AS centroid_y, 1 AS y_pred, predicted_prob AS y_prob FROM edits WHERE predicted_prob >= 0.6""")
def _(spark, sf):
    df = edits(spark, sf).withColumns({"date_created": F.col("valid_from"), "y_prob": F.col("predicted_prob")})
    return R.flagged(R.flag(df, 0.6)).withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})


@check("P11_between_ids", "SELECT o_orderkey AS changeset_id, o_custkey AS user_id FROM orders WHERE o_orderkey BETWEEN 100 AND 100000")
def _(spark, sf):
    return R.between_ids(changesets(spark, sf), 100, 100_000).select("changeset_id", "user_id")


@check("P12_between_dates", EC + """
SELECT changeset_id, closed_at FROM changesets0 WHERE closed_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30 12:00:00'""")
def _(spark, sf):
    return R.between_dates(changesets(spark, sf), "1996-01-01", "1998-06-30 12:00:00").select("changeset_id", "closed_at")


@check("P13_where_eq", E + "SELECT ck, changeset_id FROM edits WHERE user_id = 7")
def _(spark, sf):
    return R.where_eq(edits(spark, sf, user=True), "user_id", 7).select("ck", "changeset_id")


@check("P14_comment_contains", EC + "SELECT changeset_id, comment FROM changesets0 WHERE contains(comment, 'vandalism')")
def _(spark, sf):
    return R.comment_contains(changesets(spark, sf), "vandalism").select("changeset_id", "comment")


@check("P14_comment_counts", EC + """
SELECT count(*) FILTER (contains(comment, 'vandalism')) AS with_word, count(comment) AS with_comment FROM changesets0""")
def _(spark, sf):
    return R.comment_counts(changesets(spark, sf), "vandalism")


@check("P14_comment_list", EC + "SELECT changeset_id, comment FROM changesets0 WHERE comment IS NOT NULL ORDER BY 1 LIMIT 100")
def _(spark, sf):
    rows = changesets(spark, sf).where("comment IS NOT NULL").select("changeset_id", "comment")
    return rows.orderBy("changeset_id").limit(100)


@check("P15_valid_points", E + "SELECT ck, centroid_x::BIGINT::DOUBLE AS centroid_x, 1.5::DOUBLE AS centroid_y FROM (SELECT ck, h % 360 AS centroid_x, h FROM edits) WHERE h % 9 > 1")
def _(spark, sf):
    text = F.when(F.col("h") % 9 == 0, F.lit("nowhere")).when(F.col("h") % 9 != 1, (F.col("h") % 360).cast("string"))
    df = edits(spark, sf).select("ck", text.alias("centroid_x"), F.lit("1.5").alias("centroid_y"))
    return R.valid_points(df)


@check("P16_decimal_comma", E + "SELECT ck, l_quantity::BIGINT + 0.25::DOUBLE AS number FROM edits")
def _(spark, sf):
    text = F.concat(F.col("l_quantity").cast("bigint"), F.lit(",25"))
    return edits(spark, sf).select("ck", texts.decimal_comma(text).alias("number"))


@check("P17_split_ids", """
SELECT changeset_id, CASE WHEN n < 600000 THEN 'train' WHEN n < 800000 THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey AS changeset_id, ('0x' || substr(md5('42|' || o_orderkey), 1, 15))::BIGINT % 1000000 AS n FROM orders)""")
def _(spark, sf):
    shares = {"train": 0.6, "val": 0.2, "test": 0.2}
    return R.split_ids(group_split(changesets(spark, sf), "changeset_id", shares))
