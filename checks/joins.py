"""Joins J1-J9 and set operations U1-U5."""

from pyspark.sql import functions as F

from checks.fixtures import (
    CHANGESETS, EDITS, EVALUATIONS, IDS, LABELS, changeset_labels, changesets, edits, evaluations, id_list, table, with_,
)
from checks.registry import check
from editwarden.functions import places
from editwarden.operators import joins as J
from editwarden.operators import tables as U
from editwarden.operators.aggregates import changeset_labels as computed_labels
from editwarden.operators.aggregates import score_profile
from editwarden.operators.sampling import group_split

SHARES = {"train": 0.5, "val": 0.1, "test": 0.2, "test_meta": 0.2}
SPLITS = """
split_ids AS (SELECT o_orderkey AS changeset_id, CASE WHEN n < 500000 THEN 'train' WHEN n < 600000 THEN 'val'
    WHEN n < 800000 THEN 'test' ELSE 'test_meta' END AS split
  FROM (SELECT o_orderkey, ('0x' || substr(md5('42|' || o_orderkey), 1, 15))::BIGINT % 1000000 AS n FROM orders))
"""
CONTINENT_LIST = "unnest([" + ", ".join(
    f"CASE WHEN xmax >= {w}::DOUBLE AND xmin <= {e}::DOUBLE AND ymax >= {s}::DOUBLE AND ymin <= {n}::DOUBLE THEN '{name}' END"
    for name, s, n, w, e in places.CONTINENT_BOXES
) + ", CASE WHEN NOT (" + " OR ".join(
    f"(xmax >= {w}::DOUBLE AND xmin <= {e}::DOUBLE AND ymax >= {s}::DOUBLE AND ymin <= {n}::DOUBLE)"
    for _, s, n, w, e in places.CONTINENT_BOXES) + ") THEN 'Other' END])"
# one row per edit and continent
PLACED = f"placed AS (SELECT * FROM (SELECT *, {CONTINENT_LIST} AS continent FROM edits) WHERE continent IS NOT NULL)"


def split_ids(spark, sf):
    return group_split(changesets(spark, sf).select("changeset_id"), "changeset_id", SHARES)


def placed(spark, sf, **more):
    found = places.continents(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    return edits(spark, sf, **more).withColumn("continents", found)


@check("J1_join_labels", with_(EDITS, CHANGESETS, LABELS) + """
SELECT changeset_id, user_id, l.label FROM changesets0 JOIN changeset_labels l USING (changeset_id)""")
def _(spark, sf):
    return J.join_labels(changesets(spark, sf).select("changeset_id", "user_id"), changeset_labels(spark, sf))


@check("J2_split_like", with_(EDITS, LABELS, SPLITS) + """
SELECT changeset_id, label, split, count(*) AS num_contributions
FROM edits JOIN changeset_labels USING (changeset_id) JOIN split_ids USING (changeset_id) GROUP BY ALL""")
def _(spark, sf):
    profiles = score_profile(edits(spark, sf)).select("changeset_id", "num_contributions")
    return J.split_like(profiles, changeset_labels(spark, sf), split_ids(spark, sf))


@check("J3_missing_ids", with_(SPLITS) + """
SELECT split, count(*) AS missing, array_to_string(list(changeset_id ORDER BY changeset_id)[1:10], ',') AS examples
FROM split_ids WHERE changeset_id NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    return J.missing_ids(split_ids(spark, sf), edits(spark, sf))


@check("J4_label_conflicts", with_(EDITS, EVALUATIONS, LABELS) + """
SELECT changeset_id, y_true AS y_true_a, (NOT label)::BIGINT AS y_true_b FROM evaluations JOIN (
  SELECT changeset_id, CASE WHEN changeset_id % 5 = 0 THEN label ELSE NOT label END AS label FROM changeset_labels)
  USING (changeset_id) WHERE y_true <> (NOT label)::BIGINT""")
def _(spark, sf):
    flipped = F.when(F.col("changeset_id") % 5 == 0, ~F.col("label")).otherwise(F.col("label")).cast("bigint")
    other = changeset_labels(spark, sf).select("changeset_id", flipped.alias("y_true"))
    return J.label_conflicts(evaluations(spark, sf), other)


@check("J5_stack_inputs", with_(EDITS, EVALUATIONS) + "SELECT changeset_id, y_true, y_prob_main, y_prob_hyper FROM evaluations")
def _(spark, sf):
    e = evaluations(spark, sf)
    return J.stack_inputs(e.drop("y_prob_hyper"), e.drop("y_prob_main"))


@check("J6_meta_scores", with_(EDITS, EVALUATIONS, SPLITS) + """
SELECT changeset_id, y_true, y_prob_main, y_prob_hyper, (y_prob_main + y_prob_hyper) / 2 AS y_prob_meta,
  (y_prob_main >= 0.5)::INTEGER AS y_pred_main, (y_prob_hyper >= 0.5)::INTEGER AS y_pred_hyper,
  ((y_prob_main + y_prob_hyper) / 2 >= 0.5)::INTEGER AS y_pred_meta
FROM evaluations JOIN split_ids USING (changeset_id) WHERE split = 'test_meta'""")
def _(spark, sf):
    e = evaluations(spark, sf)
    held = split_ids(spark, sf).where("split = 'test_meta'")
    meta = e.join(held, "changeset_id").select(
        "changeset_id", ((F.col("y_prob_main") + F.col("y_prob_hyper")) / 2).alias("y_prob_meta"))
    return J.meta_scores(e, e, meta)


@check("J7_audit_labels", with_(EDITS, LABELS) + """
SELECT changeset_id, CASE WHEN v THEN 'yes' ELSE 'no' END AS computed_vandalism,
  CASE WHEN label THEN 'yes' ELSE 'no' END AS original_vandalism, (v <> label) AS discrepancy
FROM (SELECT changeset_id, bool_or(vandalism = 1) AS v FROM edits GROUP BY 1) JOIN changeset_labels USING (changeset_id)""")
def _(spark, sf):
    return J.audit_labels(computed_labels(edits(spark, sf)), changeset_labels(spark, sf))


@check("J8_by_region", with_(EDITS, PLACED) + "SELECT ck, continent AS region FROM placed")
def _(spark, sf):
    return J.by_region(placed(spark, sf).select("ck", "continents"), "continents")


def changed_copy(spark, sf):
    df = edits(spark, sf).select("ck", "area", "length", "osm_type")
    other = df.where(F.col("area") != 700).withColumn("length", F.when(F.col("length") == 50, 51).otherwise(F.col("length")))
    return df, other.withColumn("osm_type", F.when(F.col("osm_type") != "way", F.col("osm_type")))


@check("J9_diff_tables", with_(EDITS) + """
SELECT ck, 'length' AS "column", length::VARCHAR AS value_a, CASE WHEN area = 700 THEN NULL ELSE '51' END AS value_b FROM edits WHERE length = 50 OR area = 700
UNION ALL SELECT ck, 'osm_type', osm_type, CASE WHEN area = 700 OR osm_type = 'way' THEN NULL ELSE osm_type END FROM edits WHERE osm_type = 'way' OR area = 700
UNION ALL SELECT ck, 'area', area::VARCHAR, NULL FROM edits WHERE area = 700
UNION ALL SELECT ck, '<row>', 'present', NULL FROM edits WHERE area = 700""")
def _(spark, sf):
    a, b = changed_copy(spark, sf)
    return J.diff_tables(a, b, ["ck"])


@check("U1_union_all", with_(EDITS) + "SELECT changeset_id, 1 AS part FROM edits UNION ALL SELECT o_orderkey, 2 FROM orders")
def _(spark, sf):
    a = edits(spark, sf).select("changeset_id", F.lit(1).alias("part"))
    return U.union_all([a, changesets(spark, sf).select(F.lit(2).alias("part"), "changeset_id")])


@check("U2_common_ids", with_(EDITS, LABELS, IDS) + """
SELECT changeset_id FROM edits INTERSECT SELECT changeset_id FROM changeset_labels INTERSECT FROM id_list""")
def _(spark, sf):
    return U.common_ids(edits(spark, sf), changeset_labels(spark, sf), id_list(spark, sf))


@check("U3_id_overlap", with_(EDITS, LABELS) + """
SELECT changeset_id, CASE WHEN e AND l THEN 'both' WHEN l THEN 'only_a' ELSE 'only_b' END AS found FROM (
  SELECT changeset_id, bool_or(e) AS e, bool_or(NOT e) AS l FROM (
    SELECT changeset_id, true AS e FROM edits UNION ALL SELECT changeset_id, false FROM changeset_labels) GROUP BY 1)""")
def _(spark, sf):
    return U.id_overlap(changeset_labels(spark, sf), edits(spark, sf))


@check("U4_remaining", with_(EDITS) + "SELECT ck FROM edits WHERE vandalism = 0")
def _(spark, sf):
    e = edits(spark, sf)
    return U.remaining(e.select("ck"), e.where("vandalism = 1"), "ck")


@check("U5_diff_schema", """
SELECT * FROM (VALUES ('only_a', 'l_orderkey', 'bigint', NULL), ('only_b', 'o_orderkey', NULL, 'bigint'),
  ('type', 'status', 'string', 'int')) t(fact, "column", a, b)
UNION ALL SELECT 'rows', NULL, (SELECT count(*) FROM lineitem)::VARCHAR, (SELECT count(*) FROM orders)::VARCHAR""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("status"))
    b = table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("status"))
    return J.diff_schema(a, b)
