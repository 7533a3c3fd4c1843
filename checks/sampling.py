"""Samples, splits and folds L1-L11."""

from pyspark.sql import functions as F

from checks.fixtures import CHANGESETS, EDITS, edits, full_changesets, with_
from checks.joins import PLACED, placed
from checks.registry import check
from editwarden.functions import places
from editwarden.operators import regions
from editwarden.operators import sampling as L
from editwarden.operators.rows import with_month

E = with_(EDITS)
RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY vandalism ORDER BY md5('42|' || ck), ck) AS rk,
  count(*) OVER (PARTITION BY vandalism) AS n FROM edits)
"""
RANKED_SETS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || changeset_id), changeset_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM changesets)
"""
REGIONS = {"train": ["EUROPE", "ASIA"], "val": ["AFRICA"], "test": ["AMERICA", "MIDDLE EAST"]}


@check("L1_balance", with_(EDITS, RANKED) + "SELECT ck, vandalism FROM ranked WHERE rk <= (SELECT min(n) FROM ranked)")
def _(spark, sf):
    return L.balance(edits(spark, sf).select("ck", "vandalism"), "ck")


MONTHLY = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('42|' || ck), ck) AS rk, count(*) OVER (PARTITION BY month) AS n FROM edits),
taken AS (SELECT *, CASE WHEN n > 200 THEN rk > 100 AND rk <= 300 ELSE true END AS t FROM ranked)
"""


@check("L2_sample_per_group", with_(EDITS, MONTHLY) + "SELECT ck, month, 0 AS vandalism FROM taken WHERE t")
def _(spark, sf):
    df = with_month(edits(spark, sf), "valid_from").select("ck", "month")
    return L.sample_per_group(df, "month", "ck", 200, 100)[0]


@check("L2_sample_rest", with_(EDITS, MONTHLY) + "SELECT ck, month FROM taken WHERE NOT t")
def _(spark, sf):
    df = with_month(edits(spark, sf), "valid_from").select("ck", "month")
    return L.sample_per_group(df, "month", "ck", 200, 100)[1]


@check("L3_realistic_split", with_(EDITS, RANKED) + """
SELECT ck, vandalism AS label, CASE WHEN rk <= CASE vandalism WHEN 1 THEN 200 ELSE 800 END THEN 'val'
  WHEN rk <= CASE vandalism WHEN 1 THEN 800 ELSE 3200 END THEN 'test' ELSE 'train' END AS split FROM ranked""")
def _(spark, sf):
    df = edits(spark, sf).select("ck", F.col("vandalism").alias("label"))
    return L.realistic_split(df, "ck", test=3000, val=1000, ratio=0.2)


@check("L4_stratified_split", with_(EDITS, CHANGESETS, RANKED_SETS) + """
SELECT changeset_id, label, CASE WHEN rk <= round(round(n * 0.4) * 0.2) THEN 'val' WHEN rk <= round(n * 0.4) THEN 'test' ELSE 'train' END AS split
FROM ranked""")
def _(spark, sf):
    return L.stratified_split(full_changesets(spark, sf).select("changeset_id", "label"), "changeset_id", 0.4, 0.2)


@check("L5_meta_split", with_(EDITS, CHANGESETS, RANKED_SETS) + """
SELECT changeset_id, label, CASE WHEN rk <= v THEN 'val' WHEN rk <= v + round((h - v) * 0.45) THEN 'test_meta' WHEN rk <= h THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, round(n * 0.5) AS h, round(round(n * 0.5) * 0.1) AS v FROM ranked)""")
def _(spark, sf):
    return L.meta_split(full_changesets(spark, sf).select("changeset_id", "label"), "changeset_id", 0.5, 0.1, 0.45)


@check("L6_temporal_split", E + """
SELECT ck, CASE year(valid_from) WHEN 1996 THEN 'train' WHEN 1997 THEN 'train' WHEN 1995 THEN 'val' WHEN 1998 THEN 'test' END AS split
FROM edits WHERE year(valid_from) BETWEEN 1995 AND 1998""")
def _(spark, sf):
    years = {"train": [1996, 1997], "val": [1995], "test": [1998]}
    return L.temporal_split(edits(spark, sf), "valid_from", years).select("ck", "split")


@check("L7_geographic_split", with_(EDITS, PLACED) + """
SELECT DISTINCT ck, CASE WHEN continent IN ('Oceania', 'Europe', 'South America') THEN 'train'
  WHEN continent IN ('Africa', 'Antarctica', 'Other') THEN 'val' ELSE 'test' END AS split FROM placed""")
def _(spark, sf):
    from editwarden.plans.training import REGIONS as CONTINENT_REGIONS
    return L.geographic_split(placed(spark, sf), "continents", CONTINENT_REGIONS).select("ck", "split")


@check("L7_exclusive_split", E + """
SELECT ck, CASE WHEN region IN ('EUROPE', 'ASIA') THEN 'train' WHEN region = 'AFRICA' THEN 'val' ELSE 'test' END AS split FROM edits""")
def _(spark, sf):
    df = edits(spark, sf, place=True).withColumn("regions", F.array("region"))
    L.check_regions(df, "regions", REGIONS)
    return L.geographic_split(df, "regions", REGIONS, exclusive=True).select("ck", "split")


@check("L8_region_combinations", with_(EDITS, PLACED) + """
, names AS (SELECT DISTINCT continent AS c FROM placed),
pick AS (SELECT list_sort([a.c, b.c]) AS g FROM names a JOIN names b ON a.c < b.c
  UNION ALL SELECT list_sort([a.c, b.c, d.c]) FROM names a JOIN names b ON a.c < b.c JOIN names d ON b.c < d.c),
triples AS (SELECT t.g AS t, v.g AS v, (SELECT list_sort(list(c)) FROM names WHERE NOT list_contains(t.g, c) AND NOT list_contains(v.g, c)) AS s
  FROM pick t JOIN pick v ON NOT list_has_any(t.g, v.g))
SELECT array_to_string(t, ',') AS train_regions, array_to_string(v, ',') AS val_regions, array_to_string(s, ',') AS test_regions
FROM triples WHERE len(s) BETWEEN 2 AND 3""")
def _(spark, sf):
    # the regions are those that occur in the edits
    seen = placed(spark, sf).select(F.explode("continents").alias("c")).distinct()
    names = [r["c"] for r in seen.limit(len(places.CONTINENTS) + 1).collect()]
    combos = regions.region_combinations(spark, sorted(names))
    return combos.select(*[F.array_join(F.sort_array(c), ",").alias(c) for c in ("train_regions", "val_regions", "test_regions")])


@check("L9_assign_folds", with_(EDITS, RANKED) + """
SELECT ck, CASE WHEN rk <= n * 1 // 5 THEN 0 WHEN rk <= n * 2 // 5 THEN 1 WHEN rk <= n * 3 // 5 THEN 2 WHEN rk <= n * 4 // 5 THEN 3 ELSE 4 END AS fold
FROM ranked""")
def _(spark, sf):
    return L.assign_folds(edits(spark, sf).select("ck", "vandalism"), "ck", 5, "vandalism").select("ck", "fold")


@check("L10_group_split", E + """
SELECT ck, changeset_id, CASE WHEN n < 700000 THEN 'train' WHEN n < 800000 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, ('0x' || substr(md5('42|' || changeset_id), 1, 15))::BIGINT % 1000000 AS n FROM edits)""")
def _(spark, sf):
    shares = {"train": 0.7, "val": 0.1, "test": 0.2}
    return L.group_split(edits(spark, sf), "changeset_id", shares).select("ck", "changeset_id", "split")


@check("L11_group_folds", E + """
SELECT ck, ('0x' || substr(md5('42|' || grid_cell_id), 1, 15))::BIGINT % 5 AS fold FROM edits""")
def _(spark, sf):
    df = edits(spark, sf).withColumn("grid_cell_id", places.grid_cell(F.col("centroid_x"), F.col("centroid_y")))
    return L.group_folds(df, "grid_cell_id").select("ck", "fold")
