"""Edits and changesets derived from the given tables, once for Spark and once as SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editwarden.functions.hashing import hex_to_long
from editwarden.functions.tags import KEY_TAGS
from editwarden.functions.times import in_hours, in_seconds
from editwarden.sources.readers import spread

# Most rows of a side table, and most bytes of its texts, that are broadcast to the edits. Both are counted.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 100_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A side table, broadcast if it comes from few rows. Without the hint Spark takes a join of small tables for a large one and sends out the edits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _tag_map(number: Column, step: int) -> Column:
    # some key is always present, so the text is never empty
    entries = [
        F.when((number + i) % step != 0, F.concat(F.lit(f"{tag}=v"), number % (i + 2))) for i, tag in enumerate(KEY_TAGS)
    ]
    return F.str_to_map(F.concat_ws(",", *entries), F.lit(","), F.lit("="))


def _interval(h: Column) -> Column:
    """12 bytes: months, days, milliseconds, each little-endian."""
    def four_bytes(number: Column) -> Column:
        big = F.lpad(F.hex(number), 8, "0")
        return F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])

    return F.unhex(F.concat(four_bytes(h % 3), four_bytes(h % 28), four_bytes((h % 1000) * 1000)))


def edits(spark, sf, *, user=False, place=False, comment=False) -> DataFrame:
    """One row per line item. ``user``, ``place`` and ``comment`` add the columns that need joins.

    The joins come first, on the columns as they are stored: what is derived from a row is wider than the row, and is not shuffled. The texts of
    the comments come last, from the documents themselves, so that no copy of a text goes through a shuffle."""
    l = spread(table(spark, sf, "lineitem"))
    if user or place or comment:
        n_orders = table(spark, sf, "orders").count()
        o = table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"),
            in_hours(F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey") % 24).alias("changeset_ts"),
        )
        if place:
            n = table(spark, sf, "nation")
            r = table(spark, sf, "region")
            home = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
                r, F.col("n_regionkey") == F.col("r_regionkey"))
            home = home.select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("home_name"), F.col("r_name").alias("region"))
            o = o.join(_few(home, table(spark, sf, "customer").count()), "user_id")
        l = l.join(_few(o, n_orders), "l_orderkey")
    if comment:
        # one row per changeset of that number; next to the other join by that number, so that the edits are dealt by it once
        c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
        l = l.join(_few(c, n_orders), "l_orderkey")
    if place:
        seller = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        seller = seller.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("seller_name"))
        l = l.join(_few(seller, table(spark, sf, "supplier").count()), "l_suppkey")
    if comment:
        l = with_comments(spark, sf, l, F.col("l_orderkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    ck = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)
    h = F.col("h")
    quantity = F.col("l_quantity").cast("bigint")
    half_box = F.col("l_linenumber") * F.lit(0.25)
    l = l.withColumn("ck", ck).withColumn("h", hex_to_long(F.md5("ck")))
    l = l.withColumns({
        "centroid_x": (h % 3600) / F.lit(10.0) - F.lit(179.95),
        "centroid_y": (F.floor(h / 3600) % 1700) / F.lit(10.0) - F.lit(84.95),
        "valid_from": in_seconds(F.col("l_shipdate").cast("timestamp_ntz"), h % 86400),
        "vandalism": (F.col("l_returnflag") == "R").cast("bigint"),
    })
    l = l.withColumns({
        "changeset_id": F.col("l_orderkey"),
        "osm_id": F.col("l_partkey"),
        "osm_version": F.col("l_linenumber").cast("bigint"),
        "osm_type": F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), (F.col("l_suppkey") % 3 + 1).cast("int")),
        "geometry_type": F.element_at(F.array(F.lit("Point"), F.lit("LineString"), F.lit("Polygon")), (F.col("l_suppkey") % 3 + 1).cast("int")),
        "contrib_type": F.element_at(F.array(F.lit("CREATION"), F.lit("DELETION"), F.lit("TAG"), F.lit("GEOMETRY")), (F.col("l_linenumber") % 4 + 1).cast("int")),
        "valid_to": F.when(h % 4 != 0, in_hours(F.col("valid_from"), h % 1000)),
        "area": F.when(F.col("l_quantity") < 10, F.lit(0)).otherwise(quantity * 100).cast("bigint"),
        "area_delta": h % 5001 - 2500,
        "length": quantity * 10,
        "length_delta": h % 501 - 250,
        "xmin": F.col("centroid_x") - half_box,
        "xmax": F.col("centroid_x") + half_box,
        "ymin": F.col("centroid_y") - half_box,
        "ymax": F.col("centroid_y") + half_box,
        "tags_before": _tag_map(F.col("l_partkey"), 3),
        "tags": _tag_map(F.col("l_suppkey"), 4),
        "map_features": F.struct(
            (h % 2 == 0).alias("building"),
            F.when(h % 5 != 0, h % 3 == 0).alias("highway"),
            (h % 7 == 0).alias("landuse"),
        ),
        "geometry_valid": h % 10 != 0,
        "members": F.array().cast("array<string>"),
        "status": F.col("l_linestatus"),
        "geometry": F.concat(F.lit("POINT("), h % 3600, F.lit(" "), h % 1700, F.lit(")")),
        "xzcode": F.struct((h % 16).cast("int").alias("level"), (h % 100000).alias("code")),
        "centroid": F.struct(F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")),
        "predicted_prob": (h % 7000 + 3000 * F.col("vandalism")) / F.lit(10000.0),
        "interval": _interval(h),
        "previous_text": F.when(h % 17 == 0, F.lit("junk")).when(
            h % 19 != 0, F.date_format(F.col("valid_from"), "dd/MM/yyyy HH:mm")),
    })
    if place:
        l = l.withColumn("country_iso_a3", F.sort_array(F.array_distinct(F.array("home_name", "seller_name"))))
    if comment:
        pairs = [
            F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(k).alias("value")))
            for k in ("comment", "source")
        ]
        l = l.withColumn("changeset", F.struct(
            F.col("changeset_id").alias("id"),
            F.col("changeset_ts").alias("timestamp"),
            F.map_from_entries(F.array_compact(F.array(*pairs))).alias("tags"),
            F.array().cast("array<string>").alias("hashtags"),
            F.lit("editor").alias("editor"),
        ))
    return l


def with_comments(spark, sf, df: DataFrame, key: Column) -> DataFrame:
    """Add comment and source of the changeset with this number."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    n_docs, n_bytes = _sizes(documents)
    if n_docs <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        documents = F.broadcast(documents)
    return df.join(documents, key % n_docs == F.col("_doc"), "left").withColumns({
        "comment": F.when(key % 10 == 0, F.concat(F.lit("Revert vandalism in changeset "), 100000 + key))
        .when(key % 10 != 1, F.col("_text")),
        "source": F.element_at(
            F.array(F.lit("Bing Aerial Imagery"), F.lit("Esri World Imagery 2019"), F.lit("Maxar Technologies"),
                    F.lit("survey"), F.lit(None).cast("string")),
            (key % 5 + 1).cast("int"),
        ),
    }).drop("_doc", "_text")


def _sizes(documents: DataFrame) -> tuple[int, int]:
    """Rows of the documents and bytes of their texts; the texts are only read where their files are small."""
    stored = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n_bytes = F.sum(F.octet_length("_text")) if stored <= BROADCAST_BYTES else F.lit(stored)
    found = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(n_bytes, F.lit(0)).alias("bytes")).first()
    return found["n"], found["bytes"]


CHANGESET_COLUMNS = ("changeset_id", "user_id", "created_at", "closed_at", "created_by", "account_created", "comment", "source")


def _sessions(spark, sf) -> DataFrame:
    """One row per order, without its comment."""
    key, created = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        key.alias("changeset_id"),
        F.col("o_custkey").alias("user_id"),
        created.alias("created_at"),
        in_hours(created, key % 24).alias("closed_at"),
        F.col("o_orderpriority").alias("created_by"),
        in_hours(created, -24 * (F.col("o_custkey") % 1000)).alias("account_created"),
    )


def changesets(spark, sf) -> DataFrame:
    """One row per order, without the figures that come from its edits."""
    return with_comments(spark, sf, _sessions(spark, sf), F.col("changeset_id")).select(*CHANGESET_COLUMNS)


def full_changesets(spark, sf, labels: DataFrame | None = None) -> DataFrame:
    """Changesets with number of edits, bounding box and label from their edits.

    ``labels`` (changeset_id, label) replaces the label and leaves the changesets it names."""
    per = edits(spark, sf).groupBy("changeset_id").agg(
        F.count(F.lit(1)).alias("num_changes"),
        F.min("xmin").alias("min_lon"), F.max("xmax").alias("max_lon"),
        F.min("ymin").alias("min_lat"), F.max("ymax").alias("max_lat"),
        F.max("vandalism").alias("label"),
    )
    rows = _sessions(spark, sf).join(per, "changeset_id", "left").withColumns({
        "num_changes": F.coalesce("num_changes", F.lit(0)),
        "label": F.coalesce("label", F.lit(0)),
    })
    if labels is not None:
        rows = rows.drop("label").join(labels, "changeset_id")
    # the texts last: they are not shuffled
    figures = [c for c in rows.columns if c not in CHANGESET_COLUMNS]
    return with_comments(spark, sf, rows, F.col("changeset_id")).select(*CHANGESET_COLUMNS, *figures)


def changeset_labels(spark, sf) -> DataFrame:
    """Labels of the changesets with urgent or high priority, and of 50 that do not exist."""
    flagged = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("flag"))
    known = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(
        flagged, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("changeset_id"), (F.coalesce("flag", F.lit(0)) == 1).alias("label"))
    unknown = spark.range(50).select((-1 - F.col("id")).alias("changeset_id"), F.lit(True).alias("label"))
    return known.unionByName(unknown)


def id_list(spark, sf) -> DataFrame:
    """Changesets that are finished."""
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("changeset_id"))


def evaluations(spark, sf) -> DataFrame:
    """Two probabilities per changeset: mean and maximum of the scores of its edits."""
    e = edits(spark, sf)
    return e.groupBy("changeset_id").agg(
        F.max("vandalism").alias("y_true"),
        F.round(F.avg("predicted_prob"), 9).alias("y_prob_main"),
        F.max("predicted_prob").alias("y_prob_hyper"),
    )


# --- the same in SQL ---------------------------------------------------------------------

EDITS = """
edits0 AS (
  SELECT *, ('0x' || substr(md5(ck), 1, 8))::BIGINT AS h FROM (
    SELECT l.*, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                          CAST(round(l_extendedprice * 100) AS BIGINT)) AS ck
    FROM lineitem l)),
edits1 AS (
  SELECT e.*, (h % 3600) / 10.0::DOUBLE - 179.95::DOUBLE AS centroid_x,
    ((h // 3600) % 1700) / 10.0::DOUBLE - 84.95::DOUBLE AS centroid_y,
    l_shipdate::TIMESTAMP + to_seconds(h % 86400) AS valid_from,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::BIGINT AS vandalism,
    o_custkey AS user_id, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INTEGER) AS changeset_ts,
    cn.n_name AS home_name, sn.n_name AS seller_name, r_name AS region
  FROM edits0 e JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region ON r_regionkey = cn.n_regionkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey),
edits AS (
  SELECT *, l_orderkey AS changeset_id, l_partkey AS osm_id, l_linenumber::BIGINT AS osm_version,
    ['node', 'way', 'relation'][l_suppkey % 3 + 1] AS osm_type,
    ['Point', 'LineString', 'Polygon'][l_suppkey % 3 + 1] AS geometry_type,
    ['CREATION', 'DELETION', 'TAG', 'GEOMETRY'][l_linenumber % 4 + 1] AS contrib_type,
    CASE WHEN h % 4 <> 0 THEN valid_from + to_hours((h % 1000)::INTEGER) END AS valid_to,
    CASE WHEN l_quantity < 10 THEN 0 ELSE l_quantity::BIGINT * 100 END::BIGINT AS area,
    h % 5001 - 2500 AS area_delta, l_quantity::BIGINT * 10 AS length, h % 501 - 250 AS length_delta,
    centroid_x - l_linenumber * 0.25::DOUBLE AS xmin, centroid_x + l_linenumber * 0.25::DOUBLE AS xmax,
    centroid_y - l_linenumber * 0.25::DOUBLE AS ymin, centroid_y + l_linenumber * 0.25::DOUBLE AS ymax,
    h % 10 <> 0 AS geometry_valid, (h % 7000 + 3000 * vandalism) / 10000.0::DOUBLE AS predicted_prob,
    list_sort(list_distinct([home_name, seller_name])) AS countries,
    strftime(valid_from, '%Y-%m') AS month,
    trunc((centroid_x + 180) / 0.1::DOUBLE)::BIGINT || '_' || trunc((centroid_y + 90) / 0.1::DOUBLE)::BIGINT AS grid_cell_id
  FROM edits1)
"""

CHANGESETS = """
changesets0 AS (
  SELECT o_orderkey AS changeset_id, o_custkey AS user_id, o_orderdate::TIMESTAMP AS created_at,
    o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INTEGER) AS closed_at, o_orderpriority AS created_by,
    o_orderdate::TIMESTAMP - to_days((o_custkey % 1000)::INTEGER) AS account_created,
    CASE WHEN o_orderkey % 10 = 0 THEN 'Revert vandalism in changeset ' || (100000 + o_orderkey)
         WHEN o_orderkey % 10 <> 1 THEN d.text END AS comment,
    ['Bing Aerial Imagery', 'Esri World Imagery 2019', 'Maxar Technologies', 'survey', NULL][o_orderkey % 5 + 1] AS source
  FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey % (SELECT count(*) FROM documents)),
changesets AS (
  SELECT c.*, coalesce(p.num_changes, 0) AS num_changes, min_lon, max_lon, min_lat, max_lat, coalesce(p.label, 0) AS label
  FROM changesets0 c LEFT JOIN (
    SELECT changeset_id, count(*) AS num_changes, min(xmin) AS min_lon, max(xmax) AS max_lon,
      min(ymin) AS min_lat, max(ymax) AS max_lat, max(vandalism) AS label FROM edits GROUP BY 1) p USING (changeset_id))
"""

LABELS = """
labels0 AS (
  SELECT o_orderkey AS changeset_id, coalesce(bool_or(l_returnflag = 'R'), false) AS label
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1),
changeset_labels AS (
  SELECT * FROM labels0 UNION ALL SELECT -1 - i, true FROM range(50) t(i))
"""

IDS = "id_list AS (SELECT o_orderkey AS changeset_id FROM orders WHERE o_orderstatus = 'F')"

EVALUATIONS = """
evaluations AS (
  SELECT changeset_id, max(vandalism) AS y_true, round(avg(predicted_prob), 9) AS y_prob_main,
    max(predicted_prob) AS y_prob_hyper FROM edits GROUP BY 1)
"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"
