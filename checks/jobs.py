"""Sources S1-S9, sinks K1-K12, scoring and streaming G1-G5: what is written is read back and compared."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import (
    CHANGESETS, EDITS, IDS, LABELS, changeset_labels, edits, full_changesets, id_list, table, with_,
)
from checks.learning import SETTINGS, small_training
from checks.metrics import bootstrapped, scored
from checks.registry import SQL, check
from editwarden.operators import bootstrap as B
from editwarden.operators import metrics as V
from editwarden.operators import tables as U
from editwarden.operators.aggregates import monthly_summary
from editwarden.operators.rows import conform, flag, with_month
from editwarden.plans.features import features_or_load
from editwarden.plans.scoring import Scorer, SummaryStore, score_edits, score_months
from editwarden.session import scratch_path
from editwarden.sources import readers, writers
from editwarden.sources.writers import FILE_ROWS
from editwarden.streaming import daily

E = with_(EDITS)
SUMMARY_SQL = """SELECT month, count(*) AS total_entries, count(*) FILTER (predicted_prob >= 0.5) AS vandalism_count,
  printf('%.4f', count(*) FILTER (predicted_prob >= 0.5) * 100.0::DOUBLE / count(*)) AS vandalism_percentage FROM edits"""


def narrow(spark, sf):
    """Edits as (key, time, month and score columns) for the written tables."""
    df = edits(spark, sf).select(
        "ck", "changeset_id", "osm_id", "osm_version", "centroid_x", "centroid_y", F.col("valid_from").alias("date_created"),
        F.col("predicted_prob").alias("y_prob"))
    return with_month(flag(df), "date_created")


@check("S1_read_edits", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _(spark, sf):
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_quantity", T.DoubleType())])
    return readers.read_edits(spark, os.path.join(sf, "lineitem.parquet"), schema)


def month_folders(spark, sf):
    """Edits in folders named like month=1995-01-01."""
    path = scratch_path(spark, "months")
    df = edits(spark, sf).select("ck", F.date_format(F.date_trunc("month", "valid_from"), "yyyy-MM-dd").alias("month"))
    df.repartition("month").write.partitionBy("month").parquet(path)
    return path


@check("S2_read_one_month", E + "SELECT ck FROM edits WHERE month = '1996-05'")
def _(spark, sf):
    return readers.read_edits(spark, month_folders(spark, sf), None, month="1996-05-01").select("ck")


@check("S3_file_month", "SELECT o_orderkey, NULL::VARCHAR AS file_month FROM orders")
def _(spark, sf):
    # the names of the given files hold no month
    return readers.with_file_month(table(spark, sf, "orders")).select("o_orderkey", "file_month")


@check("S4_read_labels", with_(LABELS) + "SELECT changeset_id, label AS vandalism FROM changeset_labels")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    changeset_labels(spark, sf).select(F.col("changeset_id").alias("changeset"), "label").write.csv(path, sep="\t", header=True)
    return readers.read_labels(spark, path)


@check("S5_read_ids", with_(IDS) + "FROM id_list")
def _(spark, sf):
    path = scratch_path(spark, "ids")
    id_list(spark, sf).write.csv(path, header=True)
    return readers.read_ids(spark, path)


@check("S6_read_changesets_xml", with_(EDITS, CHANGESETS) + """
SELECT changeset_id, created_at, closed_at, 'user ' || user_id AS user, user_id, num_changes, created_by,
  CASE WHEN comment LIKE 'Revert%' THEN comment END AS comment, CASE WHEN ok THEN min_lat END AS min_lat, CASE WHEN ok THEN min_lon END AS min_lon,
  CASE WHEN ok THEN max_lat END AS max_lat, CASE WHEN ok THEN max_lon END AS max_lon
FROM (SELECT * REPLACE (round(min_lat, 6) AS min_lat, round(min_lon, 6) AS min_lon, round(max_lat, 6) AS max_lat, round(max_lon, 6) AS max_lon),
  round(min_lat, 6) >= -90 AND round(max_lat, 6) <= 90 AND round(min_lon, 6) >= -180 AND round(max_lon, 6) <= 180 AS ok FROM changesets)
WHERE changeset_id BETWEEN 1 AND 1000000""")
def _(spark, sf):
    path = scratch_path(spark, "history")
    c = full_changesets(spark, sf)

    def attribute(name, column):
        return F.when(column.isNotNull(), F.concat(F.lit(f' {name}="'), column.cast("string"), F.lit('"'))).otherwise("")

    def stamp(name):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    comment = F.when(F.col("comment").startswith("Revert"), F.concat(F.lit('<tag k="comment" v="'), "comment", F.lit('"/>'))).otherwise("")
    line = F.concat(
        F.lit("<changeset"), attribute("id", F.col("changeset_id")), attribute("created_at", stamp("created_at")),
        attribute("closed_at", stamp("closed_at")), attribute("user", F.concat(F.lit("user "), "user_id")),
        attribute("uid", F.col("user_id")), attribute("num_changes", F.col("num_changes")),
        *[attribute(n, F.round(n, 6)) for n in ("min_lat", "min_lon", "max_lat", "max_lon")], F.lit(">"), comment,
        F.lit('<tag k="created_by" v="'), F.col("created_by"), F.lit('"/></changeset>'))
    c.select(line).write.text(path)
    return readers.read_changesets_xml(spark, path, 1, 1_000_000)


@check("S7_features_cache", E + "SELECT count(*) AS edits, sum(area)::BIGINT AS area, count(DISTINCT osm_id) AS elements FROM edits")
def _(spark, sf):
    from checks.learning import full_edits
    path = scratch_path(spark, "features")
    features_or_load(full_edits(spark, sf), path, SETTINGS)
    # the second call finds the stored table and does not look at the edits it is given
    again = features_or_load(full_edits(spark, sf).limit(0), path, SETTINGS)
    return again.agg(F.count(F.lit(1)).alias("edits"), F.sum("area").alias("area"), F.countDistinct("osm_id").alias("elements"))


@check("S8_read_month_range", E + "SELECT ck FROM edits WHERE month BETWEEN '1996-05' AND '1997-02'")
def _(spark, sf):
    return readers.read_edits(spark, month_folders(spark, sf), None, start="1996-05-01", end="1997-02-01").select("ck")


@check("S9_describe_schema", """
SELECT column_index AS position, column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' END AS type
FROM (SELECT (column_index - 1)::INTEGER AS column_index, column_name, data_type FROM duckdb_columns() WHERE table_name = 'orders')""")
def _(spark, sf):
    return U.describe_schema(table(spark, sf, "orders"))


@check("K1_write_table", E + "SELECT ck, month, predicted_prob AS y_prob FROM edits")
def _(spark, sf):
    path = scratch_path(spark, "table")
    writers.write_table(narrow(spark, sf).select("ck", "month", "y_prob"), path)
    return spark.read.parquet(path)


@check("K2_save_sample", E + "SELECT least(count(*), 100) AS n FROM edits")
def _(spark, sf):
    path = scratch_path(spark, "sample")
    writers.save_sample(narrow(spark, sf), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@check("K3_write_flagged", E + "SELECT ck, month FROM edits WHERE predicted_prob >= 0.5")
def _(spark, sf):
    path = scratch_path(spark, "flagged")
    rows = narrow(spark, sf).where("y_pred = 1").select("ck", "month")
    writers.write_flagged(rows, path)
    # a second run replaces the months it covers and leaves the others
    writers.write_flagged(rows.where("month >= '1998-01'"), path)
    return spark.read.parquet(path).select("ck", F.date_format(F.to_date(F.col("month").cast("string"), "yyyy-MM"), "yyyy-MM").alias("month"))


@check("K4_append_flagged", E + "SELECT ck FROM edits WHERE predicted_prob >= 0.5")
def _(spark, sf):
    path = scratch_path(spark, "appended")
    rows = narrow(spark, sf).where("y_pred = 1").select("ck", "month", "osm_version")
    writers.append_flagged(rows.where("osm_version <= 3"), path)
    writers.append_flagged(rows.where("osm_version > 3"), path)
    return spark.read.parquet(path).select("ck")


def half_summaries(spark, sf):
    rows = narrow(spark, sf)
    return monthly_summary(rows.where("osm_version <= 3")), monthly_summary(rows.where("osm_version > 3"))


@check("K5_upsert_replace", E + SUMMARY_SQL + """ WHERE osm_version > 3 AND month >= '1998-01' GROUP BY 1
UNION ALL """ + SUMMARY_SQL + " WHERE osm_version <= 3 AND month NOT IN (SELECT month FROM edits WHERE osm_version > 3 AND month >= '1998-01') GROUP BY 1")
def _(spark, sf):
    old, new = half_summaries(spark, sf)
    return U.upsert_summary(old, new.where("month >= '1998-01'"), "replace")


@check("K6_upsert_add", E + SUMMARY_SQL + " GROUP BY 1")
def _(spark, sf):
    store = SummaryStore(spark, scratch_path(spark, "summary"))
    old, new = half_summaries(spark, sf)
    store.add("old", old)
    store.add("new", new)
    store.add("new", new)  # a repeated run adds nothing
    return store.read().drop("updated_at")


@check("K7_write_by_quarter", E + "SELECT year(valid_from)::INTEGER AS year, quarter(valid_from)::INTEGER AS quarter, count(*) AS n FROM edits GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "quarters")
    writers.write_by_quarter(narrow(spark, sf), "date_created", path)
    return spark.read.parquet(path).groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("n"))


@check("K8_compact", E + "SELECT ck, month FROM edits")
def _(spark, sf):
    path = scratch_path(spark, "compact")
    writers.compact(narrow(spark, sf).select("ck", "month"), path, 3, "ck")
    return spark.read.parquet(path)


@check("K9_write_eval", with_(EDITS) + """
SELECT count(*) FILTER (vandalism = 0 AND predicted_prob < 0.5) AS "TN", count(*) FILTER (vandalism = 0 AND predicted_prob >= 0.5) AS "FP",
  count(*) FILTER (vandalism = 1 AND predicted_prob < 0.5) AS "FN", count(*) FILTER (vandalism = 1 AND predicted_prob >= 0.5) AS "TP" FROM edits""")
def _(spark, sf):
    path = scratch_path(spark, "evaluation")
    rows = scored(spark, sf)
    writers.write_eval(rows, V.confusion(rows), path)
    return spark.read.csv(os.path.join(path, "confusion"), header=True, schema="TN bigint, FP bigint, FN bigint, TP bigint")


@check("K10_write_bootstrap", SQL["V14_bootstrap_summary"])
def _(spark, sf):
    """The summary file, read back."""
    path = scratch_path(spark, "bootstrap")
    df = bootstrapped(spark, sf)
    writers.write_bootstrap({"all_iterations": df, "summary": B.bootstrap_summary(df), "statistics": B.bootstrap_shape(df)}, path)
    figures = spark.read.csv(os.path.join(path, "bootstrap_summary"), header=True)
    return figures.withColumns({c: F.round(F.col(c).cast("double"), 7) for c in ("mean", "std_dev", "ci_lower", "ci_upper")})


@check("K11_conform", E + "SELECT ck, osm_version::INTEGER AS osm_version, NULL::VARCHAR AS note, (vandalism = 1) AS vandalism FROM edits")
def _(spark, sf):
    schema = T.StructType([
        T.StructField("ck", T.StringType()), T.StructField("osm_version", T.IntegerType()), T.StructField("note", T.StringType()),
        T.StructField("vandalism", T.BooleanType())])
    return conform(edits(spark, sf).select("vandalism", "osm_version", "ck", "area"), schema)


@check("K12_save_and_load", E + "SELECT count(*) AS edits, 0::BIGINT AS differing FROM edits")
def _(spark, sf):
    df, result = small_training(spark, sf)
    path = scratch_path(spark, "scorer")
    result.scorer.save(path, spark)
    a = score_edits(df, result.scorer).select("contribution_key", "y_prob")
    b = score_edits(df, Scorer.load(path, spark)).select("contribution_key", F.col("y_prob").alias("other"))
    return a.join(b, "contribution_key").agg(
        F.count(F.lit(1)).alias("edits"), F.count_if(F.abs(F.col("y_prob") - F.col("other")) > 1e-9).alias("differing"))


@check("G1_score_months", E + "SELECT month, count(*) AS total_entries FROM edits GROUP BY 1")
def _(spark, sf):
    df, result = small_training(spark, sf)
    flagged, summary = score_months(df, result.scorer, scratch_path(spark, "monthly"))
    # flagged counts of the summary agree with the flagged table, or the join loses the month
    per_month = flagged.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    both = summary.join(per_month, "month", "left").where(F.col("vandalism_count") == F.coalesce("n", F.lit(0)))
    return both.select(F.date_format("month", "yyyy-MM").alias("month"), "total_entries") if dict(summary.dtypes)["month"] == "date" else both.select(
        "month", "total_entries")


def daily_files(spark, sf, most=FILE_ROWS):
    """Edits in files of one year each, as a stream reads them; a year of many rows is dealt to several files."""
    path = scratch_path(spark, "daily")
    rows = narrow(spark, sf)
    parts = max(1, -(-rows.count() // (7 * most)))
    rows.repartition(7 * parts, F.year("date_created"), F.crc32("ck") % parts).write.option("maxRecordsPerFile", most).parquet(path)
    return path


def run_stream(spark, path, out, checkpoint):
    stream = daily.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=2)
    query = daily.score_stream(stream, lambda batch: batch, out, checkpoint)
    query.awaitTermination()
    return query


@check("G2_score_stream", E + SUMMARY_SQL + " GROUP BY 1")
def _(spark, sf):
    out = scratch_path(spark, "stream")
    run_stream(spark, daily_files(spark, sf), os.path.join(out, "out"), os.path.join(out, "checkpoint"))
    return daily.summary_of_batches(spark, os.path.join(out, "out"))


@check("G2_equals_G1", E + "SELECT month, count(*) AS total_entries, 0::BIGINT AS differing FROM edits GROUP BY 1")
def _(spark, sf):
    """A saved model scores the files in two runs of the stream as the monthly job scores them at once."""
    df, result = small_training(spark, sf)
    path, model, out = (scratch_path(spark, n) for n in ("daily", "scorer", "stream"))
    result.scorer.save(model, spark)
    for part in ("osm_version <= 2", "osm_version > 2"):
        df.where(part).repartition(2).write.mode("append").parquet(path)
        store = daily.score_new_files(spark, path, spark.read.parquet(path).schema, model, out, os.path.join(out, "checkpoint"), files_per_batch=1)
    score_months(df, Scorer.load(model, spark), os.path.join(out, "monthly"))
    columns = ["contribution_key", "month", "y_pred", F.round("y_prob", 9).alias("y_prob")]
    streamed, whole = (spark.read.parquet(os.path.join(out, p)).withColumn("month", F.date_format(F.to_date("month", "yyyy-MM"), "yyyy-MM")).select(*columns)
                       for p in ("scores", "monthly/scores"))
    differing = streamed.exceptAll(whole).union(whole.exceptAll(streamed)).groupBy("month").agg(F.count(F.lit(1)).alias("differing"))
    return store.read().select("month", "total_entries").join(differing, "month", "left").fillna(0, ["differing"])


@check("G3_only_new_files", E + "SELECT changeset_id, osm_id, count(*) AS n FROM edits WHERE predicted_prob >= 0.5 GROUP BY 1, 2")
def _(spark, sf):
    out, path = scratch_path(spark, "stream"), scratch_path(spark, "daily")
    rows = narrow(spark, sf)
    for part in ("osm_version <= 2", "osm_version > 2"):
        rows.where(part).write.mode("append").parquet(path)
        run_stream(spark, path, os.path.join(out, "out"), os.path.join(out, "checkpoint"))
    return daily.stored_batches(spark, os.path.join(out, "out")).groupBy("changeset_id", "osm_id").agg(F.count(F.lit(1)).alias("n"))


@check("G4_stream_summary", """
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS total_entries, count(*) FILTER (value >= 250) AS vandalism_count,
  printf('%.4f', count(*) FILTER (value >= 250) * 100.0::DOUBLE / count(*)) AS vandalism_percentage FROM events GROUP BY 1""")
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = daily.read_stream(spark, sf, schema, pattern="events.parquet")
    totals = daily.stream_summary(flag(stream, 250, "value"), "ts")
    folder = scratch_path(spark, "totals")

    def store(batch, number):
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(os.path.join(folder, "state"))

    query = totals.writeStream.outputMode("complete").foreachBatch(store).option(
        "checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(os.path.join(folder, "state"))


@check("G5_snapshot_counts", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP, TIMESTAMP '2000-01-01') AS start, count(*) AS edits, count(*) FILTER (value >= 250) AS flagged FROM events GROUP BY 1""")
def _(spark, sf):
    rows = flag(table(spark, sf, "events"), 250, "value")
    return daily.snapshot_counts(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@check("flagged_share_per_month", E + """
SELECT month, count(*) AS total_entries, count(*) FILTER (s >= 0.5) AS vandalism_count,
  printf('%.4f', count(*) FILTER (s >= 0.5) * 100.0::DOUBLE / count(*)) AS vandalism_percentage,
  count(DISTINCT grid_cell_id) AS cells FROM (SELECT *, predicted_prob AS s FROM edits) GROUP BY 1""")
def _(spark, sf):
    """The flagship query: place, tag and time features, score, flag, month summary."""
    return flagship(spark, sf)


def flagship(spark, sf):
    from editwarden.functions import places
    from editwarden.functions.texts import percentage_text
    rows = narrow(spark, sf).withColumn("cell", places.grid_cell(F.col("centroid_x"), F.col("centroid_y")))
    total, bad = F.count(F.lit(1)), F.sum(F.col("y_pred").cast("bigint"))
    return rows.groupBy("month").agg(
        total.alias("total_entries"), bad.alias("vandalism_count"), percentage_text(bad, total).alias("vandalism_percentage"),
        F.countDistinct("cell").alias("cells"))
